import pytest
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.operators import records
from unisource.operators.records import endpoint_fields, json_file_fields


def rows(df):
    return [(r["path"], r["row_no"], r["t"]) for r in df.withColumn("t", F.to_json("row")).orderBy("path", "row_no").collect()]


def fields(df):
    found = {}
    for r in df.orderBy("path", "position").collect():
        found.setdefault(r["path"], []).extend([(r["name"], r["type"])] if r["position"] is not None else [])
    return found


BODIES = [
    ('[{"a":1},{"a":2}]',), ('{"x":[],"y":[{"a":1}]}',), ('{"a":1}',), ("[]",), ("7",), ("[1,2]",), ("{bad",), ("",),
    ('{"z":[{"a":1}],"b":[{"a":2}]}',), ('{"s":"[1]","o":{"q":[1]}}',), (None,),
]


def test_rest_rows(land):
    assert rows(records.rest_rows(land(*BODIES))) == [
        ("p0", 0, '{"a":1}'), ("p0", 1, '{"a":2}'), ("p2", 0, '{"a":1}'), ("p5", 0, "1"), ("p5", 1, "2"),
        ("p8", 0, '{"a":1}'), ("p9", 0, '{"o":{"q":[1]},"s":"[1]"}'),
    ]


def test_file_records_skip_empty_lists(land):
    got = rows(records.file_records(land(*BODIES)))
    assert ("p1", 0, '{"a":1}') in got and [r for r in got if r[0] == "p3"] == []


def test_odata_rows(land):
    got = rows(records.odata_rows(land(
        ('{"value":[{"a":1},{"a":2}]}',), ('{"value":[]}',), ('{"value":5}',), ('{"a":1}',), ("[1]",), ("x",),
    )))
    assert got == [("p0", 0, '{"a":1}'), ("p0", 1, '{"a":2}'), ("p2", 0, '{"value":5}'), ("p3", 0, '{"a":1}')]


@pytest.mark.parametrize(
    "value,expected,name",
    [
        ("42", "integer", "int"), ("3.14", "float", "float"), ("true", "boolean", "bool"), ('"hello"', "string", "str"),
        ('"2024-01-15"', "date", "str"), ("1.0", "float", "float"), ("1e5", "float", "float"),
        ("123456789012345678901", "integer", "int"), ("null", "string", "NoneType"), ('{"a":1}', "object", "dict"),
        ("[1]", "array", "list"), ('"2024-01-15x"', "date", "str"), ('" 2024-01-15"', "string", "str"),
        ("-9223372036854775809", "integer", "int"), ("0", "integer", "int"), ("1234567890.5", "float", "float"),
    ],
)
def test_value_types(spark, value, expected, name):
    df = spark.createDataFrame([('{"k":%s}' % value,)], "b string").select(F.get(J.entries("b"), 0)["value"].alias("v"))
    got = df.select(J.value_type(F.col("v")), J.value_class(F.col("v"))).first()
    assert (got[0], got[1]) == (expected, name)


def test_entries_keep_order_and_last_value(spark):
    df = spark.createDataFrame([('{"z":1,"a":2,"z":"x","m.n":3}',)], "b string")
    got = df.select(F.transform(J.entries("b"), lambda e: F.concat_ws("=", e["key"], e["value"].try_cast("string")))).first()[0]
    assert got == ["z=x", "a=2", "m.n=3"]


def test_endpoint_fields(land):
    got = fields(records.endpoint_fields(land(
        ("s", "c", '{"id": 1, "name": "A", "active": true}'), ("s", "u", '[{"id": 1}, {"id": 2}]'), ("s", "x", "[]"),
        ("s", "l", "[1,2]"), ("s", "n", "5"), ("s", "bad", "{"), ("s", "nested", '{"v":[{"a":1}]}'),
        ("s", "text", '["{\\"a\\":1}"]'),
    )))
    assert got == {
        "p0": [("id", "integer"), ("name", "string"), ("active", "boolean")], "p1": [("id", "integer")], "p2": [],
        "p4": [], "p6": [("v", "array")],
    }


def test_endpoint_name_from_path(spark):
    from unisource import schemas

    df = spark.createDataFrame([("s", "", None, "/a/b/", 200, '{"x":1}')], schemas.LANDED)
    assert records.endpoint_fields(df).first()["entity"] == "a/b"


def test_json_file_fields(land):
    found = records.json_file_fields(land(
        ("s", "f", '[{"z":1,"a":"2024-01-01"},{"q":1}]'), ("s", "f", '{"e":[],"d":[{"b":null,"a":1.5}]}'),
        ("s", "f", '{"b":{"x":1},"a":[]}'), ("s", "f", "[]"), ("s", "f", "7"), ("s", "f", '{"d":[1,2]}'),
        ("s", "f", '["{\\"a\\":1}"]'),
    ))
    assert fields(found) == {
        "p0": [("z", "integer"), ("a", "date")], "p1": [("b", "string"), ("a", "float")],
        "p2": [("b", "object"), ("a", "array")], "p3": [], "p4": [], "p5": [], "p6": [],
    }
    described = {r["path"]: r["entity_description"] for r in found.collect()}
    assert described == {
        "p0": "JSON - 2 enregistrements, 2 champs", "p1": "JSON - 1 enregistrements, 2 champs",
        "p2": "JSON - 1 enregistrements, 2 champs", "p3": "JSON - 0 enregistrements, 0 champs", "p4": None,
        "p5": "JSON - 2 enregistrements, 0 champs", "p6": "JSON - 1 enregistrements, 0 champs",
    }


def test_record_types(spark):
    df = spark.createDataFrame(
        [("g", '{"a":1,"b":null}'), ("g", '{"a":2.5,"c":"x","b":true}'), ("g", '{"c":null}'), ("h", '{"a":null}')],
        "g string, body string",
    )
    got = {(r["g"], r["name"]): (r["type"], r["position"]) for r in records.record_types(df, ["g"]).collect()}
    assert got == {("g", "a"): ("string", 0), ("g", "b"): ("boolean", 1), ("g", "c"): ("string", 0), ("h", "a"): ("string", 0)}
    merged = {(r["g"], r["name"]): r["type"] for r in records.record_types(df, ["g"], merge_numeric=True).collect()}
    assert merged[("g", "a")] == "float"


def test_unreadable(land):
    got = records.unreadable(land(("{bad",), ("[1]",), ('{"a":1}',), ('{"a":{"x":1,"x":2}}',), ("7",)))
    assert sorted(r["path"] for r in got.collect()) == ["p0", "p3"]


def test_library_entities(land):
    """Objects and lists of objects give an entity; an empty list gives none."""
    got = fields(records.endpoint_fields(land(
        ("s", "c", '{"id": 1, "name": "A", "active": true}'), ("s", "u", '[{"id": 1}, {"id": 2}]'), ("s", "x", "[]"), ("s", "n", "5"),
        ("s", "l", "[1]"),
    ), "lib"))
    assert got == {"p0": [("id", "integer"), ("name", "string"), ("active", "boolean")], "p1": [("id", "integer")]}


def all_fields(df):
    return [(r.path, r.entity, r.position, r.name, r.type) for r in df.orderBy("path", "position").collect()]


def test_all_records_make_the_schema(land):
    """Keys of late records, mixed types, nulls, and the shapes that have no records."""
    landed = land(
        ('[{"a":1,"b":null},{"c":"2024-01-01","a":2.5},7,{"b":true}]',), ('{"x":1,"y":[1]}',), ("[]",), ("[1,2]",), ("3",), ("{broken",),
        ("[{},{}]",), ('[[1],{"k":{}}]',), (None,), ('["{\\"no\\":1}"]',),
    )
    assert all_fields(endpoint_fields(landed, mode="all")) == [
        ("p0", "e", 0, "a", "string"), ("p0", "e", 1, "c", "date"), ("p0", "e", 2, "b", "boolean"),
        ("p1", "e", 0, "x", "integer"), ("p1", "e", 1, "y", "array"), ("p2", "e", None, None, None), ("p4", "e", None, None, None),
        ("p6", "e", None, None, None), ("p7", "e", 0, "k", "object"),
    ]
    assert [r[0] for r in all_fields(endpoint_fields(landed, "lib", "all"))] == ["p0", "p0", "p0", "p1", "p1", "p6", "p7"]


def test_all_records_agree_with_the_first_where_there_is_one(land):
    bodies = ['{"a":1,"b":"x"}', '[{"a":1,"z":2,"c":null}]', '{"rows":[{"q":1.5}]}', "[]", "5", '{"rows":[1]}', '{"a":[],"b":[[]]}']
    landed = land(*[(b,) for b in bodies])
    for run in (endpoint_fields, json_file_fields):
        first, every = ([tuple(r) for r in run(landed, mode=m).orderBy("path", "position").collect()] for m in ("first", "all"))
        assert first == every


def test_json_file_counts_all_records(land):
    got = json_file_fields(land(('{"n":[],"rows":[{"a":1},2,{"b":1}]}',), ("[]",), ("7",)), mode="all").orderBy("path", "position").collect()
    assert [(r.path, r.entity_description, r.name) for r in got] == [
        ("p0", "JSON - 3 enregistrements, 2 champs", "a"), ("p0", "JSON - 3 enregistrements, 2 champs", "b"),
        ("p1", "JSON - 0 enregistrements, 0 champs", None), ("p2", None, None),
    ]


def test_merge_numeric_over_records(land):
    from unisource.functions import json as J
    from unisource.operators.records import all_records

    landed = land(('[{"a":1},{"a":2.5}]',)).select(
        "source_id", "path", "entity_hint", J.items("body").alias("_items"), J.item_texts("body").alias("_texts"), F.lit(True).alias("_found")
    )
    assert [all_records(landed, m).first()["keys"][0]["type"] for m in (False, True)] == ["string", "float"]


def test_one_row_per_key_leaves_a_task(land, plan):
    text = plan(endpoint_fields(land(("[]",)), mode="all"))
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text
