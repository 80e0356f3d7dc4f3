import json

import pytest
from pyspark.sql import functions as F

from unisource.functions.text import first_page, page_number
from unisource.operators.dynamics import attribute_fields
from unisource.operators.records import endpoint_fields, rest_rows
from unisource.sources import endpoints, jdbc


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """Endpoints as local files, so no network is needed."""
    folder = tmp_path_factory.mktemp("served")
    (folder / "users.json").write_text('[{"id":1,"name":"é"},{"id":2}]', encoding="utf-8")
    (folder / "orders.json").write_text('{"items":[{"no":1}]}')
    endpoints.register(spark)
    listed = [
        {"path": "/users.json", "entity_name": "users"}, {"path": "/gone.json"}, {"path": "/orders.json", "entity_name": "orders"},
    ]
    return (
        spark.read.format("unisource_endpoints").option("base_url", folder.as_uri()).option("source_id", "s")
        .option("endpoints", json.dumps(listed)).load()
    )


def test_endpoints_land(served):
    got = {r["entity_hint"]: r for r in served.collect()}
    assert set(got) == {"users", "gone.json", "orders"}
    assert got["users"]["status"] == 200 and got["users"]["body"].startswith('[{"id":1')
    assert got["gone.json"]["status"] is None  # a failing endpoint is a row, not a failed job
    assert served.rdd.getNumPartitions() == 3


def test_endpoints_feed_operators(served):
    ok = served.filter(F.col("status") < 400)
    assert {r["entity"] for r in endpoint_fields(ok).collect()} == {"users", "orders"}
    assert rest_rows(ok).count() == 3


def test_endpoint_filters_leave_out_requests():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = endpoints.EndpointReader({
        "base_url": "file:///x", "dialect": "dynamics_entities", "endpoints": json.dumps([{"path": "/a"}, {"path": "/b/"}]),
    })
    assert list(reader.pushFilters([EqualTo(("entity_hint",), "b"), GreaterThan(("status",), 1)])) == [GreaterThan(("status",), 1)]
    assert [(p.path, p.entity, "$top" in p.params) for p in reader.partitions()] == [("/b/", "b", False)]


def test_default_endpoint():
    assert [(p.path, p.entity) for p in endpoints.EndpointReader({"base_url": "x"}).partitions()] == [("/", "root")]


def test_dictionary_queries():
    for database, parts in jdbc.DICTIONARY_SQL.items():
        assert set(parts) == {"columns", "primary_keys", "references"}
        for part in parts:
            assert "{schema}" not in jdbc.dictionary_query(database, part, "sa'les")
    assert "'sa''les'" in jdbc.dictionary_query("postgresql", "columns", "sa'les")


def test_group_references(spark):
    df = spark.createDataFrame(
        [("s", "t", "fk1", 2, "b", "r", "y"), ("s", "t", "fk1", 1, "a", "r", "x"), ("s", "t", "fk2", 1, "c", "q", "z")],
        "source_id string, table_name string, constraint_name string, ordinal_position int, column_name string, referred_table string, referred_column string",
    )
    got = {r["referred_table"]: (r["constrained"], r["referred"]) for r in jdbc.group_references(df).collect()}
    assert got == {"r": (["a", "b"], ["x", "y"]), "q": (["c"], ["z"])}


def test_partitioned_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        jdbc.read_table(spark, {"url": "jdbc:x"}, "t", partition_column="id")


def test_registered_columns(spark):
    spark.range(3).select("id", F.lit("a").alias("v")).createOrReplaceTempView("known")
    got = [(r["column_name"], r["native_type"], r["position"]) for r in jdbc.registered_columns(spark, "s", ["known"]).collect()]
    assert got == [("id", "bigint", 0), ("v", "string", 1)]


def test_service_endpoints():
    assert endpoints.service_endpoints("odata") == [{"path": "/$metadata", "entity_name": "odata"}]
    assert endpoints.service_endpoints("dynamics_attributes", ["account"]) == [
        {"path": "/api/data/v9.2/EntityDefinitions(LogicalName='account')/Attributes", "entity_name": "account"}
    ]
    x3 = endpoints.service_endpoints("sage_x3", folder="PROD")
    assert len(x3) == 12 and x3[0]["path"] == "/api/x3/erp/PROD/CUSTOMER/$descriptor"
    assert [e["entity_name"] for e in endpoints.service_endpoints("sage_cloud")][:2] == ["ledger_accounts", "journals"]


def paged(spark, folder, pages, dialect, **options):
    """Rows that the reader lands from local files, which name each other as next pages."""
    for name, doc in pages.items():
        (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc), encoding="utf-8")
    endpoints.register(spark)
    listed = [{"path": "/first", "entity_name": "account", "params": {}}]
    reader = endpoints.EndpointReader({
        "base_url": folder.as_uri(), "source_id": "crm", "dialect": dialect, "endpoints": json.dumps(listed), **options,
    })
    reader.params = {}
    (partition,) = reader.partitions()
    return spark.createDataFrame(list(reader.read(partition)), endpoints.LANDED)


def test_pages_are_followed(spark, tmp_path):
    pages = {
        "first": {"value": [{"LogicalName": "a1", "IsPrimaryId": True}], "@odata.nextLink": "second"},
        "second": {"value": [{"LogicalName": "b1"}, {"LogicalName": "b2"}], "@odata.nextLink": (tmp_path / "third").as_uri()},
        "third": {"value": [{"LogicalName": "c1"}]},
    }
    landed = paged(spark, tmp_path, pages, "dynamics_attributes")
    got = landed.collect()
    assert [(r.path, r.status, r.entity_hint) for r in got] == [("/first", 200, "account"), ("/first#page=2", 200, "account"), ("/first#page=3", 200, "account")]
    assert "b2" in got[1].body
    definitions = spark.createDataFrame([("crm", "", "", "d", 200, '{"value":[{"LogicalName":"account"}]}')], endpoints.LANDED)
    found = attribute_fields(definitions, landed.repartition(3)).orderBy("position").collect()
    assert [(r.position, r.name, r.primary_key) for r in found] == [(0, "a1", True), (1, "b1", False), (2, "b2", False), (3, "c1", False)]
    assert [r.name for r in attribute_fields(definitions, landed, top_attributes=2).orderBy("position").collect()] == ["a1", "b1"]


@pytest.mark.parametrize(
    ("pages", "expected"),
    [
        ({"first": {"@odata.nextLink": "second"}, "second": {"@odata.nextLink": "first"}}, [200, 200]),
        ({"first": {"@odata.nextLink": "first"}}, [200]),
        ({"first": {"@odata.nextLink": "gone"}}, [200, None]),
        ({"first": {"d": {"results": [], "__next": "second"}}, "second": "no json"}, [200, 200]),
        ({"first": {"@odata.nextLink": "https://elsewhere.invalid/x"}}, [200, None]),
        ({"first": {"@odata.nextLink": 7}}, [200]),
        ({"first": [1, 2]}, [200]),
    ],
)
def test_pages_end(spark, tmp_path, pages, expected):
    """At a repeated, missing, foreign or odd link, and at a reply that is no object."""
    landed = paged(spark, tmp_path, pages, "dynamics_entities").collect()
    assert [r.status for r in landed] == expected
    if expected[-1] is None and "elsewhere" in str(pages):
        assert "another server" in landed[-1].body


def test_other_dialects_have_one_page(spark, tmp_path):
    assert paged(spark, tmp_path, {"first": {"@odata.nextLink": "first2"}, "first2": {}}, "rest").count() == 1


def test_page_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(f"/x#page={i}",) for i in (10, 2)] + [("/x",), ("/y#page=z",)], "path string")
    got = {r.path: (r.a, r.n) for r in df.select("path", first_page("path").alias("a"), page_number("path").alias("n")).collect()}
    assert got == {"/x#page=10": ("/x", 10), "/x#page=2": ("/x", 2), "/x": ("/x", 1), "/y#page=z": ("/y#page=z", 1)}
