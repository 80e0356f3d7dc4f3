"""Changes of several tables as one snapshot."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from unisource.operators import pages
from unisource.plans.catalog import Catalog, pattern_grams
from unisource.plans.snapshots import MERGED, ConcurrentChange, bucket_number, bucket_of
from unisource.schemas import CONNECTION_TESTS, DISCOVERED
from unisource.streaming import jobs

REQUEST = "id string, name string, connector_type string, host string, database_name string, base_url string"
START = dt.datetime(2024, 1, 1)


def found(spark, *rows):
    return spark.createDataFrame([(s, "p", i, e, "table", None, 0, f, "integer", "INT", False, True, False, "") for i, (s, e, f) in enumerate(rows)], DISCOVERED)


def test_rows(spark, *rows):
    return spark.createDataFrame([(i, s, ok, 5, m, START + dt.timedelta(hours=h)) for i, s, ok, m, h in rows], CONNECTION_TESTS)


test_rows.__test__ = False


@pytest.fixture
def catalog(spark, tmp_path):
    made = Catalog(spark, f"{tmp_path}/catalog")
    made.create_sources(spark.createDataFrame([(f"s{i}", f"S{i}", "rest", None, None, "http://u") for i in range(4)], REQUEST))
    made.save_metadata(found(spark, ("s0", "a", "x"), ("s0", "b", "y"), ("s1", "c", "z")), spark.createDataFrame([("s0",), ("s1",)], "source_id string"))
    return made


def state(catalog):
    return (
        sorted((r.source_id, r.name) for r in catalog.entities().collect()), sorted((r.source_id, r.name) for r in catalog.fields().collect()),
        sorted((r.id, r.entity_count) for r in catalog.sources().collect()),
    )


def test_half_written_sync_is_unseen(spark, catalog):
    before = state(catalog)
    synced = spark.createDataFrame([("s0",)], "source_id string")
    half = catalog.prepare_metadata(found(spark, ("s0", "new", "n")), synced)
    assert state(catalog) == before  # all files are there, no manifest names them
    assert state(Catalog(spark, catalog.snapshots.root)) == before
    catalog._publish(*half)
    assert state(catalog) == ([("s0", "new"), ("s1", "c")], [("s0", "n"), ("s1", "z")], [("s0", 1), ("s1", 1), ("s2", 0), ("s3", 0)])


def test_a_second_writer_is_noticed(spark, catalog):
    synced = spark.createDataFrame([("s0",)], "source_id string")
    mine, other = (catalog.prepare_metadata(found(spark, ("s0", name, "n")), synced) for name in ("mine", "other"))
    catalog._publish(*mine)
    with pytest.raises(ConcurrentChange):
        catalog._publish(*other)
    assert ("s0", "mine") in state(catalog)[0] and ("s0", "other") not in state(catalog)[0]
    catalog.save_metadata(found(spark, ("s0", "third", "n")), synced)
    assert ("s0", "third") in state(catalog)[0]


def test_rows_of_sources_that_were_not_synced_are_left_out(spark, catalog):
    catalog.save_metadata(found(spark, ("s0", "n", "x"), ("s1", "stray", "x")), spark.createDataFrame([("s0",)], "source_id string"))
    assert state(catalog)[0] == [("s0", "n"), ("s1", "c")]


def test_segments_are_merged(spark, catalog):
    for i in range(2 * MERGED):
        catalog.update_sources(spark.createDataFrame([("s0", f"name {i}")], "id string, name string"))
    snapshot = catalog.snapshots.latest()
    assert len(snapshot.paths("sources")) <= 2 * (MERGED - 1)
    assert sum("/level-1-" in p for p in snapshot.paths("sources")) == 2
    assert {r.id: r.name for r in catalog.sources().collect()} == {"s0": f"name {2 * MERGED - 1}", "s1": "S1", "s2": "S2", "s3": "S3"}


def test_ordered_patches(spark, catalog):
    patches = spark.createDataFrame([("s0", "late", 2), ("s0", "early", 1)], "id string, name string, at int")
    catalog.update_sources(patches, order_by="at")
    assert catalog.sources().filter("id = 's0'").first()["name"] == "late"


def test_only_the_bucket_of_a_source_is_read(spark, catalog):
    assert {bucket_number(s) for s in ("s0", "x", "é")} == {r[0] for r in spark.createDataFrame([("s0",), ("x",), ("é",)], "s string").select(bucket_of("s")).collect()}
    assert all(f"bucket={bucket_number('s0')}/" in f for f in catalog.fields("s0").inputFiles())
    assert sorted(r.name for r in catalog.fields("s0").collect()) == ["x", "y"]
    assert catalog.fields("nobody").count() == 0


def test_a_page_opens_the_files_that_hold_it(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/pages")
    catalog.create_sources(spark.createDataFrame([("big", "Big", "rest", None, None, "http://u")], REQUEST))
    rows = found(spark, *[("big", f"e{i * 7919 % 1000:04d}", "x") for i in range(1000)])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "90")
    try:
        catalog.save_metadata(rows, spark.createDataFrame([("big",)], "source_id string"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = len(catalog.entities().inputFiles())
    assert files >= 11
    names = [f"e{i:04d}" for i in range(1000)]
    for page in (1, 2, 7, 19, 20, 21):
        got = catalog.entity_page("big", page, 50)
        assert [r.name for r in got.collect()] == names[(page - 1) * 50 : page * 50]
        assert len(got.inputFiles()) <= 2
    assert [r.name for r in pages.entity_page(catalog.entities(), "big", 20, 50).collect()] == names[950:]
    assert {r.field_count for r in catalog.detail("big", 13, 50).collect()} == {1}
    with pytest.raises(ValueError):
        catalog.entity_page("big", 0)


def test_a_search_opens_the_files_that_can_match(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/search")
    catalog.create_sources(spark.createDataFrame([("big", "Big", "rest", None, None, "http://u")], REQUEST))
    names = [f"{word}_{i:03d}" for word in ("Orders", "invoice", "Éléments", "x\\y", "ab", "a%b") for i in range(60)] + ["K\u212aelvin", "İx", "q"]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        catalog.save_metadata(found(spark, *[("big", n, "x") for n in names]), spark.createDataFrame([("big",)], "source_id string"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    everything = catalog.entities()
    for text in ("ORD", "ders_01", "d%s_0_1", "voice", "é", "ments_0", "lém", "x\\\\y", "ab", "b_0", "a%b", "kelv", "KKE", "nothing", "rs_059", "İ", "q", "___", "%"):
        for page in (1, 2):
            want = [r.name for r in pages.entity_page(everything, "big", page, 25, text).collect()]
            assert [r.name for r in catalog.search("big", text, page, 25).collect()] == want, text
    assert len(everything.inputFiles()) >= 9
    rows = [f for f in catalog.search("big", "voice_03").inputFiles() if "/entities/" in f]
    assert 0 < len(rows) <= 3
    assert [r.name for r in catalog.detail("big", search="invoice_017").collect()] == ["invoice_017"]


def test_pattern_grams():
    assert pattern_grams("Order_12%345") == ["345", "der", "ord", "rde"]
    assert pattern_grams("ab") == pattern_grams("a_b%c") == pattern_grams("a\\bcd") == pattern_grams("") == []
    assert pattern_grams("éabcé") == ["abc"]


def test_batches_count_once_and_late_tests_change_nothing(spark, catalog):
    assert catalog.save_tests(test_rows(spark, ("t1", "s0", False, "HTTP 503", 10)), ("stream", 0))
    assert not catalog.save_tests(test_rows(spark, ("t1", "s0", False, "HTTP 503", 10)), ("stream", 0))
    assert catalog.save_tests(test_rows(spark, ("t0", "s0", True, "ok", 1)), ("stream", 1))
    assert sorted(r.id for r in catalog.connection_tests().collect()) == ["t0", "t1"]
    assert catalog.sources().filter("id = 's0'").first()["error_message"] == "HTTP 503"


def test_stream_into_the_catalog(spark, catalog, tmp_path):
    landing, checkpoint = f"{tmp_path}/landing", f"{tmp_path}/checkpoint"

    def land(*rows):
        test_rows(spark, *rows).coalesce(1).write.mode("append").parquet(landing)

    def run():
        query = jobs.stream_tests_into(spark, landing, catalog, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None

    land(("a", "s0", True, "ok", 1), ("b", "s1", False, "HTTP 500", 1))
    run()
    land(("c", "s0", False, "HTTP 502", 3), ("b", "s1", False, "HTTP 500", 1))  # b lands again
    land(("old", "s1", True, "ok", 0))  # before the last test of s1
    run()
    run()  # nothing new
    assert sorted(r.id for r in catalog.connection_tests().collect()) == ["a", "b", "c", "old"]
    got = {r.id: (r.status, r.error_message) for r in catalog.sources().collect()}
    assert got["s0"] == ("error", "HTTP 502") and got["s1"] == ("error", "HTTP 500") and got["s2"] == ("pending", None)


def test_all_tables_change_together(spark, catalog):
    relations = spark.createDataFrame(
        [("r", "s0", "e", "f", "x", "y", "many_to_one", 1.0, False)],
        "id string, source_id string, source_entity_id string, target_entity_id string, source_field string, target_field string, relation_type string, confidence double, is_confirmed boolean",
    )
    version = catalog.snapshots.latest().version
    catalog.save_metadata(found(spark, ("s0", "n", "x")), spark.createDataFrame([("s0",)], "source_id string"), relations)
    assert catalog.snapshots.latest().version == version + 1 and catalog.relations("s0").count() == 1
    gone = catalog.delete_sources(spark.createDataFrame([("s0",)], "id string"))
    assert [r.id for r in gone.collect()] == ["s0"] and catalog.relations().count() == 0
    assert state(catalog) == ([("s1", "c")], [("s1", "z")], [("s1", 1), ("s2", 0), ("s3", 0)])
