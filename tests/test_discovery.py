from pyspark.sql import functions as F

from unisource.operators import dictionary, dynamics, edmx, fields, relations, sage, sap
from unisource.plans.sync import discover

V4 = "http://docs.oasis-open.org/odata/ns/edm"
V2 = "http://schemas.microsoft.com/ado/2008/09/edm"


def xml(inner, ns=V4):
    return (
        '<?xml version="1.0"?><edmx:Edmx xmlns:edmx="http://docs.oasis-open.org/odata/ns/edmx"><edmx:DataServices>'
        f'<Schema Namespace="NS" xmlns="{ns}" xmlns:sap="http://www.sap.com/Protocols/SAPData">{inner}</Schema>'
        "</edmx:DataServices></edmx:Edmx>"
    )


ORDER = (
    '<EntityType Name="Order"><Key><PropertyRef Name="Id"/><PropertyRef Name="No"/></Key>'
    '<Property Name="Id" Type="Edm.Int32" Nullable="FALSE" sap:label="The id"/><Property Name="No"/>'
    '<Property Name="Blob" Type="Edm.Binary"><Annotation Term="x.Other" String="o"/>'
    '<Annotation Term="x.DisplayName" String="Data"/></Property>'
    '<NavigationProperty Name="Lines" Type="Collection(NS.Line)"/><NavigationProperty Name="Owner" ToRole="Customer"/>'
    "</EntityType>"
)


def listed(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("path", "entity_no", "position").collect()]


def test_edmx_fields(land):
    got = listed(edmx.edmx_fields(land((xml(ORDER),))), "entity", "position", "name", "type", "native_type", "nullable", "primary_key", "foreign_key")
    assert got == [
        ("Order", 0, "Id", "integer", "Edm.Int32", False, True, False),
        ("Order", 1, "No", "string", "Edm.String", True, True, False),
        ("Order", 2, "Blob", "string", "Edm.Binary", True, False, False),
        ("Order", 3, "Lines", "relation", "Collection(NS.Line)", True, False, True),
        ("Order", 4, "Owner", "relation", "Customer", True, False, True),
    ]


def test_edmx_variants(land):
    body = xml(ORDER + '<EntityType Name="Base" Abstract="true"><Property Name="x"/></EntityType><EntityType Name="Empty"/>', V2)
    landed = land(("s", "svc", body))
    names = lambda v: [r[0] for r in edmx.edmx_fields(landed, v).select("entity").distinct().orderBy("entity").collect()]
    assert names("odata") == ["Base", "Order"] and names("sap") == ["Base", "Order"] and names("dynamics") == ["Order"]
    sap_labels = {r["name"]: r["description"] for r in edmx.edmx_fields(landed, "sap").filter("entity = 'Order'").collect()}
    assert sap_labels["Id"] == "The id" and sap_labels["No"] == ""
    lib = {r["name"]: (r["description"], r["entity_description"]) for r in edmx.edmx_fields(landed, "dynamics_lib").collect()}
    assert lib["Blob"] == ("Data", "Dynamics 365 Entity: Order")
    natives = {r["name"]: r["native_type"] for r in edmx.edmx_fields(landed, "sap").filter("entity = 'Order'").collect()}
    assert natives["Owner"] == ""  # only the generic reader falls back to the role


def test_edmx_shapes(land):
    one = '<EntityType Name="One"><Property Name="a"/></EntityType>'
    two = xml(one).replace("</edmx:DataServices>", f'<Schema xmlns="{V4}"><EntityType><Property Name="b"/></EntityType></Schema></edmx:DataServices>')
    bare = f'<Schema xmlns="{V4}">{one}</Schema>'
    got = listed(edmx.edmx_fields(land((two,), ("<broken",), ("",), (None,), (bare,))), "path", "entity", "name")
    assert got == [("p0", "One", "a"), ("p0", "Unknown", "b"), ("p4", "One", "a")]


def test_edmx_keys_and_relations(land):
    landed = land((xml(ORDER + '<EntityType Name="NoKey"><Property Name="x"/></EntityType>'),))
    assert [(r["entity"], r["key_no"], r["field"]) for r in edmx.edmx_keys(landed).orderBy("key_no").collect()] == [
        ("Order", 0, "Id"), ("Order", 1, "No")
    ]
    got = {(r["source_field"], r["target_entity"], r["relation_type"]) for r in edmx.nav_relations(landed).collect()}
    assert got == {("Lines", "Line", "one_to_many"), ("Owner", "Customer", "many_to_one")}


def test_rfc_rows(land):
    landed = land(("s", "DD02L", '{"DATA":[{"WA":" A \\t"},{"WA":"  "},{"WA":"B"},{"WA":"C"}]}'), ("s", "x", "bad"))
    assert [r["wa"] for r in sap.rfc_rows(landed).orderBy("row_no").collect()] == ["A", "B", "C"]
    assert [r["wa"] for r in sap.rfc_rows(landed, 3).orderBy("row_no").collect()] == ["A", "B"]


def test_rfc_columns(land):
    body = (
        '{"FIELDS":[{"FIELDNAME":"TABNAME","OFFSET":"000000","LENGTH":"000004"},'
        '{"FIELDNAME":"TABCLASS","OFFSET":"000004","LENGTH":"000006"}],'
        '"DATA":[{"WA":"T1  TRANSP"},{"WA":"V1  VIEW"},{"WA":"T2  TRANSP"},{"WA":"T3  TRANSP"}]}'
    )
    got = sap.rfc_columns(land((body,)), ["TABNAME", "TABCLASS"], 2, F.col("TABCLASS") == sap.TABLE_CLASS)
    assert [r["TABNAME"] for r in got.orderBy("row_no").collect()] == ["T1", "T2"]


def test_listed_tables_are_the_first_of_each_source(spark, plan):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("source_id"), F.lit("p").alias("path"),
        F.col("id").cast("int").alias("row_no"), F.col("id").cast("string").alias("wa"),
    )
    tables = sap.listed_tables(df, 200)
    counts = {r["source_id"]: (r["n"], r["m"]) for r in tables.groupBy("source_id").agg(F.count("*").alias("n"), F.max("row_no").alias("m")).collect()}
    assert counts == {"a": (200, 597), "hot": (200, 299)}
    assert "WindowGroupLimit" in plan(tables)  # ranked within each task before the exchange
    assert sap.listed_tables(df, None).count() == 3000


def test_abap_and_bapi(land):
    landed = land(
        ("s", "T1", '{"FIELDS":[{"FIELDNAME":"A","DATATYPE":"DATS","KEYFLAG":"X","FIELDTEXT":"t"},{"FIELDNAME":"B"},{"FIELDNAME":"C","DATATYPE":"INT8"}]}'),
        ("s", "T2", '{"FIELDS":[]}'), ("s", "T3", "bad"), ("s", "T4", '{"FIELDS":[{"FIELDNAME":"Z"}]}'),
    )
    wanted = [("T1", "A", "date", "DATS", True, "t"), ("T1", "B", "string", "", False, ""), ("T1", "C", "string", "INT8", False, "")]
    got = listed(sap.abap_fields(landed), "entity", "name", "type", "native_type", "primary_key", "description")
    assert got == wanted + [("T4", "Z", "string", "", False, "")]
    assert ("T1", "C", "integer") in listed(sap.abap_fields(landed, variant="lib"), "entity", "name", "type")
    tables = sap.listed_tables(sap.rfc_rows(land(("s", "", '{"DATA":[{"WA":"T1"},{"WA":"T4"}]}'))), 1)
    assert {r["entity"] for r in sap.abap_fields(landed, tables).collect()} == {"T1"}
    bapi = sap.bapi_fields(land(
        ("s", "F1", '{"PARAMS_AND_EXCPS":[{"PARAMETER":"P","TABNAME":"CURR","PARAMTEXT":"x"},{"PARAMETER":"Q"}]}'),
        ("s", "F2", "{}"), ("s", "F3", "bad"),
    ))
    assert listed(bapi, "entity", "position", "name", "type", "native_type") == [
        ("F1", 0, "P", "decimal", "CURR"), ("F1", 1, "Q", "string", ""), ("F2", None, None, None, None)
    ]


def test_gateway_services(land):
    names = ",".join('{"TechnicalServiceName":"S%d"}' % i for i in range(30))
    got = sap.gateway_services(land(("s", "", '{"value":[{"TechnicalServiceName":""},{"x":1},%s]}' % names)))
    assert [(r["service_no"], r["service"], r["n_services"]) for r in got.orderBy("service_no").collect()] == [
        (i, f"S{i}", 30) for i in range(30)
    ]


def test_service_names(land):
    body = xml('<EntityType Name="E"><Property Name="a"/></EntityType>')
    catalogs = land(
        ("one", "", '{"value":[{"TechnicalServiceName":"A"}]}'),
        ("two", "", '{"value":[{"TechnicalServiceName":"A"},{"TechnicalServiceName":"B"}]}'), ("none", "", "<html/>"),
    )
    docs = land(("one", "A", body), ("one", "X", body), ("two", "A", body), ("two", "B", body), ("none", "A", body))
    got = {(r["source_id"], r["entity"]) for r in sap.service_fields(catalogs, docs).collect()}
    assert got == {("one", "E"), ("two", "A__E"), ("two", "B__E"), ("none", "E")}


DEFINITIONS = (
    '{"value":[{"LogicalName":"account","PrimaryIdAttribute":"accountid","PrimaryNameAttribute":"name","IsCustomEntity":false,'
    '"DisplayName":{"UserLocalizedLabel":{"Label":"Account"}}},{"LogicalName":"new_x","IsCustomEntity":true,"DisplayName":null},'
    '{"LogicalName":"link","IsIntersect":true}]}'
)


def test_dynamics_definitions(land):
    got = listed(dynamics.definition_fields(land((DEFINITIONS,))), "entity", "entity_description", "name", "type", "nullable", "primary_key")
    assert got == [
        ("account", "Account (Standard)", "accountid", "uuid", False, True),
        ("account", "Account (Standard)", "name", "string", True, False),
        ("new_x", "new_x (Custom)", "id", "uuid", False, True), ("new_x", "new_x (Custom)", "name", "string", True, False),
    ]
    refused = land(("s", "", DEFINITIONS, 500))
    assert dynamics.definition_fields(refused).count() == 0


def test_dynamics_attributes(land):
    replies = land(
        ("s", "account", '{"value":[{"LogicalName":"a","AttributeType":"Lookup","RequiredLevel":{"Value":"None"}},'
                         '{"LogicalName":"b","AttributeType":"Money","IsPrimaryId":true,"RequiredLevel":{"Value":"Required"},'
                         '"DisplayName":{"UserLocalizedLabel":{"Label":"Bee"}}},{"LogicalName":"c"}]}'),
        ("s", "new_x", '{"value":[]}'),
    )
    got = listed(
        dynamics.attribute_fields(land((DEFINITIONS,)), replies), "entity", "name", "type", "native_type", "nullable",
        "primary_key", "foreign_key", "description",
    )
    assert got == [
        ("account", "a", "uuid", "Lookup", True, False, True, "a"), ("account", "b", "decimal", "Money", False, True, False, "Bee"),
        ("account", "c", "string", "String", True, False, False, "c"),
        ("new_x", "id", "uuid", "Edm.Guid", False, True, False, ""), ("new_x", "name", "string", "Edm.String", True, False, False, ""),
    ]


def test_dynamics_choice(land):
    defined = dynamics.definition_fields(land(("a", "", DEFINITIONS), ("b", "", '{"value":[]}')))
    docs = land(("a", "", xml(ORDER)), ("b", "", xml(ORDER)))
    got = {(r["source_id"], r["entity"]) for r in dynamics.choose_metadata(defined, docs).collect()}
    assert got == {("a", "account"), ("a", "new_x"), ("b", "Order")}


def test_x3(land):
    got = listed(
        sage.x3_fields(land(
            ("s", "CUSTOMER", '{"$fields":[{"$fieldName":"NUM","$type":"L","$isKey":true},{"$fieldName":"D","$isForeignKey":true}]}'),
            ("s", "GONE", "x", 404), ("s", "BAD", "{bad"), ("s", "NONE", "{}"),
        )), "entity", "position", "name", "type", "nullable", "primary_key", "foreign_key",
    )
    assert got == [
        ("CUSTOMER", 0, "NUM", "integer", False, True, False), ("CUSTOMER", 1, "D", "string", True, False, True),
        ("GONE", 0, "ROWID", "integer", False, True, False), ("GONE", 1, "CODE", "string", False, False, False),
        ("GONE", 2, "DESCRIPTION", "string", True, False, False), ("NONE", None, None, None, None, None, None),
    ]


def test_cloud(land):
    found = sage.cloud_fields(land(
        ("s", "contacts", '{"$items":[{"id":"x","tax_id":3,"n":null}],"value":[{"q":1}]}'), ("s", "journals", '{"value":[{"a":1.5}]}'),
        ("s", "products", '{"$items":[]}'), ("s", "currencies", "{}"), ("s", "tax_rates", '{"$items":[5]}'),
        ("s", "refused", '{"$items":[{"a":1}]}', 401), ("s", "broken", "x"), ("s", "odd", '{"$items":{"a":1}}'),
    ))
    assert listed(found, "entity", "name", "type", "native_type", "primary_key", "foreign_key") == [
        ("contacts", "id", "string", "str", True, False), ("contacts", "tax_id", "integer", "int", False, True),
        ("contacts", "n", "string", "NoneType", False, False), ("journals", "a", "float", "float", False, False),
        ("products", None, None, None, None, None), ("currencies", None, None, None, None, None),
        ("tax_rates", "id", "uuid", "string", True, False), ("tax_rates", "display_name", "string", "string", False, False),
    ]
    assert found.filter("entity = 'contacts'").first()["entity_description"] == "SAGE Business Cloud - Contacts"


def test_dictionary_and_relations(spark):
    columns = spark.createDataFrame(
        [("db", "F_DOC", "id", "INTEGER", False, 0), ("db", "F_DOC", "who", "VARCHAR(9)", None, 1), ("db", "other", "id", "BIT", True, 0)],
        "source_id string, table_name string, column_name string, native_type string, nullable boolean, position int",
    )
    pk = spark.createDataFrame([("db", "F_DOC", "id"), ("db", "F_DOC", "id")], "source_id string, table_name string, column_name string")
    fk = spark.createDataFrame(
        [("db", "F_DOC", ["who", "id"], "other", ["id"]), ("db", "F_DOC", ["id"], "elsewhere", ["id"])],
        "source_id string, table_name string, constrained array<string>, referred_table string, referred array<string>",
    )
    got = {(r["entity"], r["name"]): (r["type"], r["nullable"], r["primary_key"], r["foreign_key"]) for r in dictionary.dictionary_fields(columns, pk, fk).collect()}
    assert got == {
        ("F_DOC", "id"): ("integer", False, True, True), ("F_DOC", "who"): ("string", True, False, True),
        ("other", "id"): ("string", True, False, False),
    }
    sage100 = dictionary.sage_100_fields(columns, pk, fk).collect()
    assert {(r["entity"], r["entity_type"], r["entity_description"]) for r in sage100} == {("F_DOC", "sage100_table", "Table SAGE 100 F_DOC")}
    rel = [(r["source_field"], r["target_entity"], r["target_field"]) for r in relations.fk_relations(fk, columns).collect()]
    assert rel == [("who", "other", "id")]


def test_confidence(spark):
    parents = spark.createDataFrame([(i,) for i in range(8)], "p_id long")
    children = spark.createDataFrame([(i % 10 if i < 90 else None, i) for i in range(100)], "c_id long, value long")
    got = relations.relation_confidence({"parent": parents, "child": children}, {"parent": "p_id"}).collect()
    assert [(r["source_field"], r["n_values"], r["n_found"], r["confidence"], r["is_confirmed"]) for r in got] == [("c_id", 10, 8, 0.8, False)]


def test_discover_by_dialect(land):
    landed = (
        land(("r", "users", '[{"id":1}]'), ("o", "", xml(ORDER)), ("x", "CUSTOMER", '{"$fields":[]}'), ("f", "file", "[]"),
             ("a", "DD02L", '{"DATA":[{"WA":"T1"}]}'), ("a", "T1", '{"FIELDS":[{"FIELDNAME":"A"}]}'), ("a", "T2", '{"FIELDS":[{"FIELDNAME":"A"}]}'))
        .withColumn("dialect", F.element_at(
            F.array(*[F.lit(d) for d in ("rest", "odata", "sage_x3", "file_json", "abap_listing", "abap", "abap")]),
            F.substring("path", 2, 1).cast("int") + 1,
        ))
    )
    found = discover(landed)
    assert {(r["source_id"], r["entity"]) for r in found.collect()} == {
        ("r", "users"), ("o", "Order"), ("x", "CUSTOMER"), ("f", "file"), ("a", "T1")
    }
    summary = {r["source_id"]: (r["entity_count"], r["field_count"], r["message"]) for r in fields.sync_summary(found).collect()}
    assert summary["o"] == (1, 5, "1 entites, 5 champs synchronises") and summary["x"] == (1, 0, "1 entites, 0 champs synchronises")


def test_no_python_in_discovery(land, plan):
    for df in (edmx.edmx_fields(land((xml(ORDER),))), dynamics.definition_fields(land((DEFINITIONS,))), sage.cloud_fields(land(("{}",)))):
        assert "Python" not in plan(df)


def test_library_variants(land):
    body = xml('<EntityType Name="E"><Property Name="t" Type="Edm.TimeOfDay" Nullable="maybe"/></EntityType>')
    row = edmx.edmx_fields(land((body,)), "odata_lib").first()
    assert (row["type"], row["nullable"]) == ("time", False)
    assert edmx.edmx_fields(land((body,))).first()["nullable"]
    x3 = sage.x3_fields(land(
        ("s", "A", '{"$description":"Clients","$fields":[{"$fieldName":"N"}]}'), ("s", "B", '{"$fields":[{"$fieldName":"N"}]}'),
        ("s", "C", "x", 404), ("s", "D", "{bad"),
    ), variant="lib")
    assert {(r["entity"], r["entity_description"]) for r in x3.collect()} == {
        ("A", "Clients"), ("B", "SAGE X3 Object B"), ("D", "SAGE X3 Object D (non détaillé)")
    }
    assert x3.filter("entity = 'D'").count() == 3
    cloud = sage.cloud_fields(land(("s", "p", '{"$items":[]}'), ("s", "q", '{"$items":[{"a":1}]}')), variant="lib")
    assert listed(cloud, "entity", "name") == [("p", "id"), ("p", "display_name"), ("q", "a")]


def test_relations_become_catalog_rows(spark, land):
    landed = land(("s", "", xml(ORDER + '<EntityType Name="Line"><Property Name="x"/></EntityType>')))
    entities = fields.to_entities(edmx.edmx_fields(landed))
    ids = {r["name"]: r["id"] for r in entities.collect()}
    got = {r["source_field"]: r for r in relations.to_relations(edmx.nav_relations(landed), entities).collect()}
    assert (got["Lines"]["source_entity_id"], got["Lines"]["target_entity_id"]) == (ids["Order"], ids["Line"])
    assert (got["Owner"]["target_entity_id"], got["Owner"]["confidence"], got["Owner"]["is_confirmed"]) == (None, 1.0, False)
    assert len(got) == 2


def test_refused_listing_lists_nothing(spark):
    """A listing that was refused or is unreadable does not take a system's tables away."""
    fields = '{"FIELDS":[{"FIELDNAME":"F","DATATYPE":"C"}]}'
    rows = [
        ("s500", "abap_listing", "DD02L", "l", 500, '{"DATA":[{"WA":"OTHER"}]}'), ("sbad", "abap_listing", "DD02L", "l", 200, "<html>"),
        ("sgood", "abap_listing", "DD02L", "l", 200, '{"DATA":[{"WA":"T1"}]}'),
        *[(s, "abap", t, t, 200, fields) for s in ("s500", "sbad", "sgood", "snone") for t in ("T1", "T2")],
    ]
    landed = spark.createDataFrame(rows, "source_id string, dialect string, entity_hint string, path string, status int, body string")
    got = sorted((r.source_id, r.entity) for r in discover(landed, ["abap"]).collect())
    assert got == [("s500", "T1"), ("s500", "T2"), ("sbad", "T1"), ("sbad", "T2"), ("sgood", "T1"), ("snone", "T1"), ("snone", "T2")]


def test_catalog_pages_are_one_listing(spark):
    listing = '{"value":[{"TechnicalServiceName":"%s"}]}'
    rows = [("s", "", "", "c", 200, listing % "A"), ("s", "", "", "c#page=2", 200, listing % "B"), ("s", "", "", "c#page=10", 200, listing % "C")]
    landed = spark.createDataFrame(rows, "source_id string, dialect string, entity_hint string, path string, status int, body string")
    got = [(r.n_services, r.service_no, r.service) for r in sap.gateway_services(landed).orderBy("service_no").collect()]
    assert got == [(3, 0, "A"), (3, 1, "B"), (3, 2, "C")]


def key_tables(spark):
    """Tables whose key columns hold all, some and none of the values of each other, with nulls and other types."""
    ids = spark.range(3000)
    return {
        "shop": ids.select(F.col("id").alias("s_shop_id"), F.concat(F.lit("c"), F.col("id") % 9).alias("s_code_key")),
        "bill": ids.select(
            F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("b_shop_id"), (F.col("id") + 2000).alias("c_shop_id"), (F.col("id") + 9000).alias("d_shop_id"),
            F.lit(None).cast("bigint").alias("e_shop_id"), F.lit("c1").alias("b_code_key"), F.lit(1).alias("f_shop_id"),
        ),
        "code": spark.createDataFrame([(f"c{i}",) for i in range(5)], "k_code_key string"),
    }, {"shop": "s_shop_id", "code": "k_code_key"}


def test_confidence_in_one_pass(spark):
    """Shared masks of values give what each pair by itself gives."""
    tables, keys = key_tables(spark)
    got = {(r.source_entity, r.source_field, r.target_entity): (r.n_values, r.n_found, r.confidence) for r in relations.relation_confidence(tables, keys).collect()}
    want = {}
    for s, c, t, k in relations.key_candidates(tables, keys):
        r = relations.containment(tables[s], c, tables[t], k).first()
        want[s, c, t] = (r.n_values, r.n_found, r.n_found / r.n_values if r.n_values else 0.0)
    assert got == want and len(want) >= 6 and {v[2] for v in want.values()} >= {0.0, 1.0}
    assert ("bill", "f_shop_id", "shop") not in got  # an int is no bigint


def test_sketches_leave_out_what_cannot_reach_the_bound(spark):
    tables, keys = key_tables(spark)
    pairs = relations.key_candidates(tables, keys)
    exact = {tuple(r)[:4]: r for r in relations.relation_confidence(tables, keys).collect()}
    for least in (0.1, 0.3, 0.34, 0.9, 1.0):
        left = relations.sketched_pairs(tables, pairs, least)
        assert {p for p in pairs if exact[p].confidence >= least} <= set(left)
        assert sorted(relations.relation_confidence(tables, keys, least).collect()) == sorted(r for r in exact.values() if r.confidence >= least)
    assert ("bill", "d_shop_id", "shop", "s_shop_id") not in relations.sketched_pairs(tables, pairs, 0.9)


def test_more_columns_than_a_word_has_bits(spark):
    wide = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}_item_id") for i in range(70)])
    tables = {"item": spark.range(60).select(F.col("id").alias("i_item_id")), "wide": wide}
    got = {r.source_field: (r.n_values, r.n_found) for r in relations.relation_confidence(tables, {"item": "i_item_id"}).collect()}
    assert got == {f"c{i}_item_id": (50, max(0, min(50, 60 - i))) for i in range(70)}


def test_large_documents_are_split_by_elements(spark, tmp_path):
    """Elements of a file that many tasks read are those of the whole document, in its order."""
    many = "".join(
        f'<EntityType Name="E{i}"><Key><PropertyRef Name="k"/></Key><Property Name="k" Type="Edm.Int32" Nullable="false"/><Property Name="p{i}" sap:label="l &lt;{i}&gt;"/>'
        f'<NavigationProperty Name="n" Type="Collection(NS.E{i + 1})"/></EntityType>' if i % 5 else f'<EntityType Name="Empty{i}" Abstract="true"/>'
        for i in range(300)
    )
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "one.xml").write_text(xml(many))
    (folder / "two.xml").write_text(xml(ORDER).replace("<Schema", "\n<Schema"))
    landed = spark.read.text(str(folder), wholetext=True).select(
        F.lit("s").alias("source_id"), F.lit("").alias("entity_hint"), F.col("_metadata.file_path").alias("path"), F.lit(200).alias("status"), F.col("value").alias("body")
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert edmx.element_rows(spark, str(folder)).rdd.getNumPartitions() > 5
        assert edmx.element_rows(spark, str(folder), "edm:EntityType").count() == 0
        for variant in ("odata", "sap", "dynamics"):
            split = sorted(map(tuple, edmx.edmx_file_fields(spark, str(folder), "s", variant).collect()))
            assert split == sorted(map(tuple, edmx.edmx_fields(landed, variant).collect())) and len(split) > 700
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
