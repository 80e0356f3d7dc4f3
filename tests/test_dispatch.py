"""One-scan discovery against the operators that read one dialect each."""

import pytest
from pyspark.sql import functions as F

from test_discovery import ORDER, xml
from unisource import schemas
from unisource.operators import dictionary, edmx, fields, relations
from unisource.plans.dispatch import discover_all
from unisource.plans.sync import discover

ATTRIBUTES = '{"value":[{"LogicalName":"%s","AttributeType":"Money","IsPrimaryId":%s}]}'
ROWS = [
    ("r1", "rest", "users", "p1", 200, '[{"id":1,"n":null},{"n":2.5,"late":[1]}]'), ("r1", "rest", "", "/a/b", 200, '{"x":true}'),
    ("r1", "rest", "e", "p2", 200, "[]"), ("r1", "rest", "f", "p3", 200, "[1,2]"), ("r1", "rest", "g", "p4", 200, "7"), ("r1", "rest", "h", "p5", 200, "{bad"),
    ("r1", "rest", "pages", "q", 200, '[{"a":1}]'), ("r1", "rest", "pages", "q#page=2", 200, '[{"b":"2024-01-01"},{"a":"x"}]'),
    ("r2", "graphql", "q", "g1", None, '{"data":{"a":1}}'), ("r2", "soap", "q", "g2", 200, '{"k":"v"}'),
    ("f1", "file_json", "file", "j1", 200, '{"none":[],"rows":[{"a":1},3,{"b":2}]}'), ("f1", "file_json", "flat", "j2", 200, '{"a":1}'),
    ("f1", "file_json", "list", "j3", 200, "[]"), ("f1", "file_json", "bare", "j4", 200, "5"), ("f1", "file_json", "vals", "j5", 200, '{"rows":[1,2]}'),
    ("o1", "odata", "", "m1", 200, xml(ORDER + '<EntityType Name="Line"><Property Name="x"/></EntityType><EntityType Name="Empty"/>')),
    ("o1", "odata", "", "m2", 500, xml(ORDER)), ("o1", "odata", "", "m3", 200, "<broken"),
    ("s1", "sap_services", "", "c", 200, '{"value":[{"TechnicalServiceName":"A"}]}'), ("s1", "sap_services", "", "c#page=2", 200, '{"value":[{"TechnicalServiceName":"B"}]}'),
    ("s1", "sap_odata", "A", "sa", 200, xml(ORDER)), ("s1", "sap_odata", "B", "sb", 200, xml(ORDER)), ("s1", "sap_odata", "C", "sc", 200, xml(ORDER)),
    ("s2", "sap_services", "", "c", 403, '{"value":[{"TechnicalServiceName":"A"}]}'), ("s2", "sap_odata", "Z", "sz", 200, xml(ORDER)),
    ("s3", "sap_services", "", "c", 200, '{"value":[{"TechnicalServiceName":"A"}]}'), ("s3", "sap_odata", "A", "sa", 200, xml(ORDER)),
    ("a1", "abap_listing", "DD02L", "l", 200, '{"DATA":[{"WA":" T1 "},{"WA":""}]}'), ("a2", "abap_listing", "DD02L", "l", 500, '{"DATA":[{"WA":"T9"}]}'),
    *[(s, "abap", t, t, 200, '{"FIELDS":[{"FIELDNAME":"F","DATATYPE":"DATS","KEYFLAG":"X","FIELDTEXT":"d"},{"FIELDNAME":"G"}]}') for s in ("a1", "a2") for t in ("T1", "T2")],
    ("a1", "abap", "T1", "none", 200, '{"FIELDS":[]}'),
    ("b1", "bapi", "FM", "b", 200, '{"PARAMS_AND_EXCPS":[{"PARAMETER":"P","TABNAME":"CURR"}]}'), ("b1", "bapi", "FM0", "b0", 200, "{}"), ("b1", "bapi", "FM1", "b1", 200, "x"),
    ("d1", "dynamics_entities", "", "d", 200, '{"value":[{"LogicalName":"acc","IsCustomEntity":true},{"LogicalName":"x","IsIntersect":true},{"LogicalName":"con"}]}'),
    ("d1", "dynamics_attributes", "acc", "at", 200, ATTRIBUTES % ("a1", "true")), ("d1", "dynamics_attributes", "acc", "at#page=10", 200, ATTRIBUTES % ("a10", "false")),
    ("d1", "dynamics_attributes", "acc", "at#page=2", 200, ATTRIBUTES % ("a2", "false")), ("d1", "dynamics_attributes", "con", "cn", 404, ATTRIBUTES % ("c", "true")),
    ("d1", "dynamics_edmx", "", "dx", 200, xml(ORDER)), ("d2", "dynamics_edmx", "", "dx", 200, xml(ORDER + '<EntityType Name="B" Abstract="true"><Property Name="x"/></EntityType>')),
    ("x1", "sage_x3", "OBJ", "x", 200, '{"$fields":[{"$fieldName":"N","$type":"D","$isKey":true}]}'), ("x1", "sage_x3", "NO", "x2", 404, "no"),
    ("x1", "sage_x3", "BAD", "x3", 200, "{bad"), ("x1", "sage_x3", "NIL", "x4", 200, "{}"),
    ("c1", "sage_cloud", "contacts", "k1", 200, '{"$items":[{"id":"1","t_id":2},{"late":1.5}]}'), ("c1", "sage_cloud", "other", "k2", 200, '{"value":[]}'),
    ("c1", "sage_cloud", "bare", "k3", 200, '{"$items":[1]}'), ("c1", "sage_cloud", "gone", "k4", 403, '{"$items":[{"a":1}]}'),
    ("c1", "sage_cloud", "none", "k5", 200, '{"$items":null}'), ("c1", "sage_cloud", "odd", "k6", 200, '{"$items":7}'), ("c1", "sage_cloud", "lone", "k7", 200, '{"z":1}'),
    ("u1", "unknown", "u", "u", 200, '{"a":1}'), (None, "rest", None, None, None, None),
]


@pytest.fixture(scope="module")
def landed(spark):
    return spark.createDataFrame(ROWS, schemas.LANDED).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fields_are_those_of_each_dialect(landed):
    everything = discover_all(landed)
    assert rows(everything.fields) == rows(discover(landed).select(*everything.fields.columns))


def test_relations_and_summary(landed):
    found = discover_all(landed)
    got = {(r.source_id, r.source_entity, r.target_entity, r.source_field, r.target_field, r.relation_type) for r in found.relations.collect()}
    navigations = {("Lines", "Line", "one_to_many"), ("Owner", "Customer", "many_to_one")}
    own = {("o1", ""), ("s1", "A__"), ("s1", "B__"), ("s2", ""), ("s3", ""), ("d2", "")}
    assert got == {(s, f"{p}Order", f"{p}{t}", f, "id", k) for s, p in own for f, t, k in navigations}
    plain = {(r.source_entity, r.target_entity, r.source_field, r.relation_type) for r in edmx.nav_relations(landed.filter("dialect = 'odata' and status = 200")).collect()}
    assert {(e, t, f, k) for s, e, t, f, _, k in got if s == "o1"} == plain
    counts = {r.source_id: (r.entity_count, r.relation_count) for r in found.summary().collect()}
    assert counts["o1"] == (2, 2) and counts["s1"] == (2, 4) and counts["x1"] == (3, 0)
    entities = fields.to_entities(found.fields)
    stored = relations.to_relations(found.relations, entities).filter("source_id = 'o1'").collect()
    assert len(stored) == 2 and sum(r.target_entity_id is not None for r in stored) == 1


def test_dictionaries_are_landed_and_dispatched(spark):
    columns = spark.createDataFrame(
        [("s", "F_DOC", "id", "INTEGER", False, 1), ("s", "F_DOC", "who", "VARCHAR(9)", None, 2), ("s", "F_DOC", "b", "BIT", True, 3), ("s", "other", "id", "BIGINT", True, 1)],
        "source_id string, table_name string, column_name string, native_type string, nullable boolean, position int",
    )
    keys = spark.createDataFrame([("s", "F_DOC", "id"), ("s", "other", "id"), ("s", "F_DOC", "id")], "source_id string, table_name string, column_name string")
    references = spark.createDataFrame(
        [("s", "F_DOC", ["who", "b"], "other", ["id"]), ("s", "F_DOC", ["b"], "nowhere", ["x"]), ("s", "ghost", ["q"], "other", ["id"])],
        "source_id string, table_name string, constrained array<string>, referred_table string, referred array<string>",
    )
    for dialect, plain in (("sql", dictionary.dictionary_fields), ("sage_100", dictionary.sage_100_fields)):
        found = discover_all(dictionary.land_dictionary(columns, keys, references, dialect))
        # a landed table's fields are numbered from 0
        want = plain(columns, keys, references).withColumn("position", F.col("position") - 1)
        assert rows(found.fields) == rows(want.select(*found.fields.columns))
        known = relations.fk_relations(references.filter("table_name = 'F_DOC'"), columns).select(*found.relations.columns)
        assert rows(found.relations) == (rows(known) if dialect == "sql" else [])


def test_files_go_by_their_first_character(spark):
    bodies = {"a": '﻿ \n[{"x":1}]', "b": "x,y\n1,2\n", "c": "", "d": '{"rows":[{"q":"2024-01-01"}]}'}
    landed = spark.createDataFrame([("f", "file", n, n, 200, b) for n, b in bodies.items()], schemas.LANDED)
    found = discover_all(landed)
    assert sorted((r.entity, r.path) for r in found.csv_files.collect()) == [("b", "b"), ("c", "c")]
    assert {(r.entity, r.name, r.type) for r in found.fields.collect()} == {("d", "q", "date")} | {("a", "x", "integer")}


def test_one_scan_one_exchange(spark, landed, plan, tmp_path):
    from unisource.plans.dispatch import facts

    landed.write.parquet(f"{tmp_path}/landed")
    text = plan(facts(spark.read.parquet(f"{tmp_path}/landed")))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Python" not in text
    assert text.count("from_xml(") == 3  # one for each kind of metadata document, of which a payload takes one


def test_nothing_landed(spark):
    found = discover_all(spark.createDataFrame([], schemas.LANDED))
    assert found.fields.count() == 0 and found.relations.count() == 0 and found.csv_files.count() == 0
    assert found.fields.dtypes == discover(spark.createDataFrame([], schemas.LANDED)).select(*found.fields.columns).dtypes
