import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from unisource import schemas
from unisource.operators import changes, checks, fields, pages, status
from unisource.plans import catalog as plans_catalog
from unisource.plans.catalog import Catalog
from unisource.plans.queries import changing
from unisource.plans.sqltext import execute_query
from unisource.schemas import CONNECTION_TESTS, DISCOVERED


@pytest.fixture(scope="module")
def entities(spark):
    return spark.range(500).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), F.lit("s").alias("source_id"),
        F.concat(F.lit("name_"), (F.col("id") % 7).cast("string")).alias("name"), (F.col("id") % 50 != 0).alias("is_visible"),
    )


def expected(entities, search=""):
    rows = [r for r in entities.collect() if r["is_visible"] and search in r["name"]]
    return [r["id"] for r in sorted(rows, key=lambda r: (r["name"], r["id"]))]


def test_pages(entities):
    want = expected(entities)
    assert [r["id"] for r in pages.entity_page(entities, "s", 3, 20).collect()] == want[40:60]
    assert pages.entity_page(entities, "s", 1000, 20).count() == 0
    assert pages.entity_page(entities, "other").count() == 0
    totals = pages.page_totals(entities, "s", 1000, 20).first()
    assert (totals["total_entities"], totals["total_pages"]) == (490, 25)
    none = pages.page_totals(entities, "s", 1, 20, "zzz").first()
    assert (none["total_entities"], none["total_pages"]) == (0, 1)
    for bad in ((0, 20), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            pages.entity_page(entities, "s", *bad)


def test_search_wildcards(entities):
    assert [r["id"] for r in pages.entity_page(entities, "s", 1, 200, "E_3").collect()] == expected(entities, "e_3")
    assert pages.page_totals(entities, "s", search="n%3").first()["total_entities"] == len(expected(entities, "e_3"))


def test_deep_page_equals_offset(entities):
    want = expected(entities)
    for page in (1, 2, 13, 25, 26):
        got = [r["id"] for r in pages.entity_page(entities, "s", page, 20, deep=True).collect()]
        assert got == want[(page - 1) * 20 : page * 20]


def test_page_after(entities):
    want = expected(entities)
    first = pages.entity_page(entities, "s", 1, 20).collect()
    after = pages.entity_page_after(entities, first[-1]["name"], first[-1]["id"], "s", 20).collect()
    assert [r["id"] for r in after] == want[20:40]


def test_page_is_top_k(entities, plan):
    assert "TakeOrderedAndProject" in plan(pages.entity_page(entities, "s", 3, 20))


def some_fields(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, name string, position int").withColumns({
        "display_name": F.col("name"), "data_type": F.lit("string"), "native_type": F.lit("x"), "is_nullable": F.lit(True),
        "is_primary_key": F.lit(False), "is_foreign_key": F.lit(False),
    })


def test_entity_detail_in_parts(spark):
    rows = [("a", f"f{i}", i) for i in range(25)] + [("b", "x", 1), ("b", "y", 0)] + [("d", "late", 37), ("d", "first", 2)]
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, name string")
    got = pages.entity_detail(entities, some_fields(spark, rows), per_part=10).collect()
    found = {(r["entity_id"], r["part"]): (r["field_count"], [f["name"] for f in r["fields"]]) for r in got}
    assert found == {
        ("a", 0): (25, [f"f{i}" for i in range(10)]), ("a", 1): (25, [f"f{i}" for i in range(10, 20)]),
        ("a", 2): (25, [f"f{i}" for i in range(20, 25)]), ("b", 0): (2, ["y", "x"]), ("c", 0): (0, []),
        ("d", 0): (2, ["first"]), ("d", 3): (2, ["late"]),
    }


def test_dedup_first_place_last_attributes(spark):
    rows = [("s", "", 0, "e", "t", None, i, n, t, t, True, False, False, "") for i, (n, t) in enumerate(
        [("a", "string"), ("b", "integer"), ("a", "date"), ("c", "float"), ("a", "uuid")])]
    df = spark.createDataFrame(rows, DISCOVERED)
    got = {r["name"]: (r["position"], r["data_type"], r["display_name"]) for r in fields.to_fields(df).collect()}
    assert got == {"a": (0, "uuid", "A"), "b": (1, "integer", "B"), "c": (3, "float", "C")}
    assert fields.sync_summary(df).first()["field_count"] == 5


def test_latest_status(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "a", True, 5, "ok", t), ("2", "a", False, 9, "HTTP 500", t + dt.timedelta(1)), ("3", "b", False, 1, "x", t), ("4", "b", True, 7, "ok", t)]
    got = {r["source_id"]: (r["status"], r["test_latency_ms"], r["error_message"]) for r in status.latest_status(spark.createDataFrame(rows, CONNECTION_TESTS)).collect()}
    assert got == {"a": ("error", None, "HTTP 500"), "b": ("active", 7, None)}


@pytest.mark.parametrize(
    "kind,code,live,lib",
    [("rest", 404, True, True), ("rest", 500, False, False), ("odata", 404, True, False), ("odata", 200, True, True),
     ("dynamics365", 399, True, True), ("dynamics365", 400, False, False), ("sage_x3", 499, True, True),
     ("sage_cloud", 403, False, False), ("file", 404, False, False), ("rest", None, False, False), ("?", 200, False, False)],
)
def test_success_rules(spark, kind, code, live, lib):
    df = spark.createDataFrame([(kind, code)], "kind string, status int")
    assert status.status_rules(df).first()["success"] == live
    assert status.status_rules(df, "lib").first()["success"] == lib


def test_tests_without_status_codes(spark):
    rows = [("postgresql", None, True, "PostgreSQL 16"), ("sap_rfc", None, False, "refused"), ("mssql", None, None, None), ("sqlite", 200, False, None), ("rest", 200, False, "x")]
    df = spark.createDataFrame(rows, "kind string, status int, reached boolean, detail string")
    got = {r.kind: (r.success, r.message) for r in status.status_rules(df).collect()}
    assert got == {
        "postgresql": (True, "PostgreSQL 16"), "sap_rfc": (False, "refused"), "mssql": (False, "no answer"), "sqlite": (False, "no answer"), "rest": (True, "HTTP 200"),
    }
    assert not status.status_rules(df.drop("reached", "detail")).filter("kind = 'postgresql'").first()["success"]


def test_validation(spark):
    rows = [
        ("postgresql", "n", "h", "d", None), ("postgresql", "n", "", "d", None), ("sage_100", "n", "h", None, None),
        ("sap_rfc", "n", None, None, "u"), ("sap_rfc", "n", "h", None, None), ("rest", "n", "h", None, ""),
        ("file_csv", "n", None, None, None), ("file_csv", "x" * 256, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, connector_type string, name string, host string, database_name string, base_url string")
    got = [r["errors"] for r in checks.validate(df).orderBy("i").collect()]
    assert got == [[], [checks.HOST_MISSING], [checks.DATABASE_MISSING], [checks.RFC_HOST_MISSING], [], [checks.URL_MISSING], [], [checks.NAME_LENGTH]]


def test_hot_key_upsert(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"), (F.col("id") * 2).alias("x")
    )
    got = {r["k"]: (r["v"], r["x"]) for r in changes.upsert_latest(df, ["k"], ["v"]).collect()}
    assert got[0] == (8997 if 8997 % 3 == 0 else None, 17994) and len(got) == 50


DISCOVERED_ROWS = [
    ("s1", "p", 0, "orders", "table", None, 0, "id", "integer", "INT", False, True, False, ""),
    ("s1", "p", 0, "orders", "table", None, 1, "who_id", "integer", "INT", True, False, True, ""),
    ("s1", "p", 1, "empty_one", "table", None, None, None, None, None, None, None, None, None),
    ("s2", "p", 0, "users", "endpoint", None, 0, "id", "string", None, True, False, False, ""),
]


def test_stored_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.sources().count() == 0
    requests = spark.createDataFrame(
        [("s1", "One", "postgresql", "h", "d", None), ("s2", "Two", "rest", None, None, "http://u"), ("s3", "Bad", "rest", None, None, None)],
        "id string, name string, connector_type string, host string, database_name string, base_url string",
    )
    refused = catalog.create_sources(requests)
    assert [r["id"] for r in refused.collect()] == ["s3"]
    assert {(r["id"], r["category"], r["status"]) for r in catalog.sources().collect()} == {("s1", "database", "pending"), ("s2", "webservice", "pending")}

    both = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    catalog.save_metadata(spark.createDataFrame(DISCOVERED_ROWS, DISCOVERED), both)
    assert {(r["id"], r["entity_count"]) for r in catalog.sources().collect()} == {("s1", 2), ("s2", 1)}
    detail = {r["name"]: (r["display_name"], r["field_count"], [f["name"] for f in r["fields"]]) for r in catalog.detail("s1").collect()}
    assert detail == {"orders": ("Orders", 2, ["id", "who_id"]), "empty_one": ("Empty One", 0, [])}

    # a second sync of s1 finds one other entity; s2 keeps its rows
    new = spark.createDataFrame([("s1", "p", 0, "lines", "table", None, 0, "no", "integer", "INT", True, False, False, "")], DISCOVERED)
    catalog.save_metadata(new, both.filter("source_id = 's1'"))
    assert {(r["source_id"], r["name"]) for r in catalog.entities().collect()} == {("s1", "lines"), ("s2", "users")}
    assert {(r["source_id"], r["name"]) for r in catalog.fields().collect()} == {("s1", "no"), ("s2", "id")}

    # a sync that finds nothing empties its source
    catalog.save_metadata(spark.createDataFrame([], DISCOVERED), both.filter("source_id = 's1'"))
    assert {r["source_id"] for r in catalog.entities().collect()} == {"s2"}
    assert {(r["id"], r["entity_count"]) for r in catalog.sources().collect()} == {("s1", 0), ("s2", 1)}

    patch = spark.createDataFrame([("s1", "Renamed", None, "{}", [])], "id string, name string, host string, options string, tags array<string>")
    catalog.update_sources(patch)
    s1 = catalog.sources().filter("id = 's1'").first()
    assert (s1["name"], s1["host"], s1["options"], s1["tags"]) == ("Renamed", "h", "{}", [])
    assert s1["updated_at"] > s1["created_at"]

    tests = spark.createDataFrame([("t1", "s2", False, -1, "HTTP 503", dt.datetime(2024, 1, 1))], CONNECTION_TESTS)
    catalog.save_tests(tests)
    s2 = catalog.sources().filter("id = 's2'").first()
    assert (s2["status"], s2["error_message"], s2["test_latency_ms"]) == ("error", "HTTP 503", None)

    late = tests.withColumn("id", F.lit("late")).withColumn("tested_at", F.col("tested_at") - F.expr("INTERVAL 1 DAY"))
    catalog.save_tests(late.withColumn("error_message", F.lit("older")))
    assert catalog.sources().filter("id = 's2'").first()["error_message"] == "HTTP 503"
    assert catalog.connection_tests().count() == 2
    gone = catalog.delete_sources(spark.createDataFrame([("s2",), ("nobody",)], "id string"))
    assert [r["id"] for r in gone.collect()] == ["s2"]
    assert [r["id"] for r in catalog.sources().collect()] == ["s1"]
    assert catalog.entities().count() == 0 and catalog.fields().count() == 0
    assert catalog.connection_tests().count() == 0


def test_cascade_with_relations(spark):
    sources = spark.createDataFrame([("s1",), ("s2",)], "id string")
    entities = spark.createDataFrame([("e1", "s1"), ("e2", "s2")], "id string, source_id string")
    field_rows = spark.createDataFrame([("f1", "e1"), ("f2", "e2")], "id string, entity_id string")
    tests = spark.createDataFrame([("t1", "s1"), ("t2", "s2")], "id string, source_id string")
    relations = spark.createDataFrame([("r1", "s2", "e1", "e2"), ("r2", "s2", "e2", "e2")], "id string, source_id string, source_entity_id string, target_entity_id string")
    state = changes.cascade_delete(spark.createDataFrame([("s1",)], "id string"), sources, entities, field_rows, tests, relations)
    assert {k: [r["id"] for r in df.collect()] for k, df in state.items()} == {
        "sources": ["s2"], "entities": ["e2"], "fields": ["f2"], "deleted": ["s1"], "connection_tests": ["t2"], "relations": ["r2"],
    }


def test_named_binds_are_values(spark):
    df = spark.createDataFrame([(1, "x' OR '1'='1"), (2, "b")], "id int, v string")
    got = execute_query(spark, "SELECT id FROM t WHERE v = :v AND id >= :n", {"v": "x' OR '1'='1", "n": 0}, {"t": df})
    assert [r["id"] for r in got.collect()] == [1]


def test_integrity_of_odd_rows(spark):
    """Null keys, entities without fields, repeated names and places, and empty tables."""
    entities = spark.createDataFrame([("a", "x" * 256), ("b", "y"), (None, "z")], "id string, name string")
    rows = [("a", "n", 0, None), ("a", "n", 1, None), ("a", "m", 1, "t" * 101), ("a", None, 2, None), ("a", None, 3, None), ("gone", "n", 0, None), (None, "n", 0, None)]
    field_rows = spark.createDataFrame(rows, "entity_id string, name string, position int, native_type string")
    got = {r.rule: r.n_violations for r in checks.catalog_integrity(entities, field_rows).collect()}
    assert got == {
        "field name unique in entity": 2, "field position unique in entity": 1, "field has entity": 2, "entity text length": 1, "field text length": 1,
    }
    none = {r.n_violations for r in checks.catalog_integrity(entities.limit(0), field_rows.limit(0)).collect()}
    assert none == {0}


def test_a_sync_asks_once_for_its_sources(spark, tmp_path):
    """What names the synced sources may be a large join: it is computed once."""
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    asked = spark.sparkContext.accumulator(0)

    def seen(rows):
        for row in rows:
            asked.add(1)
            yield row

    synced = spark.createDataFrame(spark.createDataFrame([("s",), ("t",)], "source_id string").rdd.mapPartitions(seen), "source_id string")
    catalog.save_metadata(spark.createDataFrame([], schemas.DISCOVERED), synced)
    assert asked.value == 2


def test_names_are_spelled_by_bounded_tasks(spark, tmp_path, monkeypatch):
    """However many names share a triple, it is listed by as many tasks as the names ask for; a search finds all of them."""
    monkeypatch.setattr(plans_catalog, "SPELLED", 10)
    found = spark.range(200).select(
        F.lit("s").alias("source_id"), F.lit("").alias("path"), F.lit(0).alias("entity_no"), F.concat(F.lit("order_"), "id").alias("entity"),
        *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schemas.DISCOVERED.split(", ") if c.split()[0] not in ("source_id", "path", "entity_no", "entity")],
    ).select(*schemas.DISCOVERED_COLUMNS)
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.save_metadata(found, found.select("source_id"))
    (folder,) = catalog.snapshots.latest().paths("entity_grams")
    listed = spark.read.parquet(folder)
    assert "id" not in listed.columns
    assert listed.filter("gram = 'ord'").select("_metadata.file_path").distinct().count() > 5
    assert sorted(r["name"] for r in catalog.search("s", "der_11", 1, 200).collect()) == sorted(f"order_{k}" for k in range(200) if str(k).startswith("11"))


def test_stored_catalog_holds_no_source_in_one_task(spark, tmp_path, plan):
    """Entities look up their source; a left join by source would hold all entities of a source at once."""
    orders = [(k, ["1-URGENT", "2-HIGH", "5-LOW"][k % 3]) for k in range(30)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, n) for k in range(30) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changing.stored_catalog(spark, str(tmp_path))
        assert not re.search(r"Join \[(source_id|id)#\d+\], \[source_id#\d+\], LeftOuter", plan(found))
        rows = [(r.source_id, r.entity, r.position, r.entity_count) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(r for r in rows if r[0] != "5-LOW") == sorted(
        (s, f"order_{k}", n, 10) for k, s in orders if s != "5-LOW" for n in ((1, 2) if s == "2-HIGH" else (1,))
    )
    assert [r for r in rows if r[0] == "5-LOW"] == [("5-LOW", None, None, 0)]
