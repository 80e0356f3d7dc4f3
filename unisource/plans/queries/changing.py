"""Catalog changes over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.operators import changes, checks
from unisource.plans.catalog import Catalog
from unisource.plans.queries.registry import pick, query, sql_pick, table
from unisource.schemas import DISCOVERED, DISCOVERED_COLUMNS
from unisource.session import scratch_path


@query("metadata_replace", """
SELECT o_custkey AS source_id, o_orderkey AS id, o_orderpriority AS name FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)
UNION ALL
SELECT c_custkey, -c_custkey, 'new ' || c_name FROM customer WHERE c_acctbal < 1000 AND c_mktsegment <> 'BUILDING'""")
def metadata_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a low balance are synced again; those of one segment find nothing."""
    current = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")
    )
    synced = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 1000)
    found = synced.filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("source_id"), (-F.col("c_custkey")).alias("id"),
        F.concat(F.lit("new "), "c_name").alias("name"),
    )
    return changes.metadata_replace(current, synced.select(F.col("c_custkey").alias("source_id")), found)


@query("partial_update", """
SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name,
 CASE WHEN c_acctbal > 0 AND c_custkey % 2 = 0 THEN 'host' || c_custkey ELSE c_mktsegment END AS host,
 CASE WHEN c_acctbal > 0 AND c_custkey % 5 = 0 THEN '{"a":1}' ELSE '{"old":1}' END AS options,
 CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 1 THEN 0 ELSE 1 END AS n_tags FROM customer""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with gaps: null keeps, an empty options object keeps, an empty tag list sets."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    current = customers.select(
        key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("host"),
        F.lit('{"old":1}').alias("options"), F.array(F.lit("old")).alias("tags"),
    )
    patches = customers.filter(F.col("c_acctbal") > 0).select(
        key.alias("id"),
        F.when(key % 3 == 0, F.concat(F.lit("renamed "), key)).alias("name"),
        F.when(key % 2 == 0, F.concat(F.lit("host"), key)).alias("host"),
        F.when(key % 5 == 0, '{"a":1}').otherwise("{}").alias("options"),
        F.when(key % 3 == 1, F.array().cast("array<string>")).alias("tags"),
    )
    updated = changes.partial_update(current, patches)
    return updated.select("id", "name", "host", "options", F.size("tags").alias("n_tags"))


@query("upsert_latest", """
SELECT user_id, event_type AS secret_key, arg_max(value, event_id) AS secret_value, max(event_id) AS version
FROM events GROUP BY user_id, event_type""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("secret_key"), F.col("value").alias("secret_value"),
        F.col("event_id").alias("version"),
    )
    return changes.upsert_latest(log, ["user_id", "secret_key"], ["version"])


_DOOMED = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("cascade_delete", f"""
SELECT 'sources' AS kind, c_custkey AS id, c_custkey AS owner FROM customer WHERE c_custkey NOT IN ({_DOOMED})
UNION ALL SELECT 'entities', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({_DOOMED})
UNION ALL SELECT 'fields', l_partkey, l_orderkey FROM lineitem
 WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_DOOMED}))
UNION ALL SELECT 'deleted', c_custkey, c_custkey FROM customer WHERE c_custkey IN ({_DOOMED})""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete one market segment's customers with their orders and lines."""
    customers = table(spark, sf_dir, "customer")
    sources = customers.select(F.col("c_custkey").alias("id"))
    entities = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id")
    )
    fields = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("entity_id")
    )
    doomed = customers.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    state = changes.cascade_delete(doomed, sources, entities, fields)

    def rows(kind: str, owner: str) -> DataFrame:
        return state[kind].select(F.lit(kind).alias("kind"), "id", F.col(owner).alias("owner"))

    return (
        rows("sources", "id").unionByName(rows("entities", "source_id"))
        .unionByName(rows("fields", "entity_id")).unionByName(rows("deleted", "id"))
    )


_TYPES = ["postgresql", "sage_100", "rest", "sap_rfc", "odata", "file_csv", "file_excel", "unknown"]
_CATEGORY = ["database", "database", "webservice", "webservice", "webservice", "file", "file", "database"]


@query("validate_sources", f"""
SELECT c_custkey AS id, connector_type, category, coalesce(nullif(concat_ws(' | ',
  CASE WHEN name = '' THEN 'name must have 1 to 255 characters' END,
  CASE WHEN k < 2 AND coalesce(host, '') = '' THEN 'host est requis pour une connexion base de données'
       WHEN k < 2 AND coalesce(db, '') = '' THEN 'database_name est requis pour une connexion base de données'
       WHEN k = 3 AND coalesce(host, '') = '' THEN 'host est requis pour SAP RFC (ex: sap.company.com)'
       WHEN k IN (2, 4) AND coalesce(url, '') = '' THEN 'base_url est requis pour un web service' END), ''), 'ok') AS errors
FROM (SELECT c_custkey, c_custkey % 8 AS k, {sql_pick(_TYPES, "c_custkey % 8")} AS connector_type,
  {sql_pick(_CATEGORY, "c_custkey % 8")} AS category,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE 'h' END AS host,
  CASE WHEN c_custkey % 5 < 2 THEN 'd' END AS db,
  CASE WHEN c_custkey % 7 < 4 THEN 'http://u' ELSE '' END AS url FROM customer)""")
def validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        key.alias("id"), pick(_TYPES, key % 8).alias("connector_type"),
        F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 3 == 1, "").when(key % 3 == 2, "h").alias("host"),
        F.when(key % 5 < 2, "d").alias("database_name"),
        F.when(key % 7 < 4, "http://u").otherwise("").alias("base_url"),
    )
    checked = checks.categorise(checks.validate(requests))
    return checked.select(
        "id", "connector_type", "category",
        F.when(F.size("errors") == 0, "ok").otherwise(F.array_join("errors", " | ")).alias("errors"),
    )


@query("create_sources", f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {sql_pick(_CATEGORY, "c_custkey % 8")} AS category,
 {sql_pick(_TYPES, "c_custkey % 8")} AS connector_type, 'pending' AS status, 'none' AS auth_type, '{{}}' AS options,
 0 AS n_tags, 0 AS entity_count
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 8 IN (5, 6, 7)""")
def create_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that meet the rules, with the defaults of a new source."""
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.col("c_name").alias("name"), pick(_TYPES, key % 8).alias("connector_type"),
        F.when(key % 3 == 0, "h").alias("host"), F.when(key % 3 == 0, "d").alias("database_name"),
        F.when(key % 3 == 0, "u").alias("base_url"),
    )
    accepted, _ = changes.new_sources(requests)
    return accepted.select(
        "id", "name", "category", "connector_type", "status", "auth_type", "options",
        F.size("tags").alias("n_tags"), "entity_count",
    )


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as sources, orders as entities, lines as fields; some have none."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.col("l_orderkey").isNull()

    def of_field(value):
        return F.when(~empty, value)

    return found.select(
        F.col("o_orderpriority").alias("source_id"), F.lit("").alias("path"), F.lit(0).alias("entity_no"),
        F.concat(F.lit("order_"), "o_orderkey").alias("entity"), F.lit("table").alias("entity_type"),
        F.lit(None).cast("string").alias("entity_description"), F.col("l_linenumber").alias("position"),
        of_field(F.concat(F.lit("line_"), "l_linenumber")).alias("name"), of_field(F.lit("string")).alias("type"),
        of_field(F.col("l_linenumber").cast("string")).alias("native_type"), of_field(F.lit(True)).alias("nullable"),
        of_field(F.col("l_linenumber") == 1).alias("primary_key"), of_field(F.lit(False)).alias("foreign_key"),
        F.lit("").alias("description"),
    ).select(*DISCOVERED_COLUMNS)


_STORED_FIELDS = """
SELECT DISTINCT o_orderpriority AS source_id, 'order_' || o_orderkey AS entity, 'Order ' || o_orderkey AS display_name,
 'line_' || l_linenumber AS name, l_linenumber AS position, l_linenumber = 1 AS is_primary_key
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"""


def _with_entities(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Each entity with its source, and a source without entities once, as a left join would give.

    A left join by source holds all entities of a source in one task; here sources are looked up by entities.
    """
    bare = sources.join(entities.select("source_id").distinct(), "source_id", "left_anti")
    return entities.join(sources, "source_id").unionByName(bare, allowMissingColumns=True)


@query("stored_catalog", f"""
WITH found AS ({_STORED_FIELDS}), stored AS (
 SELECT * FROM found WHERE source_id NOT IN ('1-URGENT', '5-LOW')
 UNION ALL SELECT * FROM found WHERE source_id = '1-URGENT' AND position = 1),
counts AS (SELECT source_id, CAST(count(DISTINCT entity) AS INTEGER) AS entity_count FROM stored GROUP BY source_id)
SELECT source_id, entity, display_name, name, position, is_primary_key, entity_count FROM stored JOIN counts USING (source_id)
UNION ALL SELECT '5-LOW', NULL, NULL, NULL, NULL, NULL, CAST(0 AS INTEGER)""")
def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a catalog into the shared folder, sync two sources again (one finds less, one
    finds nothing), and read sources, entities and fields back."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    found = _discovered(spark, sf_dir)
    synced = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_id"))
    catalog.create_sources(
        synced.distinct().select(
            F.col("source_id").alias("id"), F.concat(F.lit("shop "), "source_id").alias("name"),
            F.lit("rest").alias("connector_type"), F.lit(None).cast("string").alias("host"),
            F.lit(None).cast("string").alias("database_name"), F.lit("http://shop").alias("base_url"),
        )
    )
    catalog.save_metadata(found, synced)
    urgent = F.col("source_id") == "1-URGENT"
    catalog.save_metadata(found.filter(urgent & (F.col("position") == 1)), synced.filter(urgent))
    catalog.save_metadata(spark.createDataFrame([], DISCOVERED), synced.filter(F.col("source_id") == "5-LOW"))
    entities = catalog.entities().select("source_id", F.col("id").alias("entity_id"), F.col("name").alias("entity"), "display_name")
    fields = catalog.fields().select("entity_id", "name", "position", "is_primary_key")
    return (
        _with_entities(catalog.sources().select(F.col("id").alias("source_id"), "entity_count"), entities)
        .join(fields, "entity_id", "left")
        .select("source_id", "entity", "display_name", "name", "position", "is_primary_key", "entity_count")
    )


def _shops(spark: SparkSession, sf_dir: str, catalog: Catalog) -> DataFrame:
    """Order priorities as the sources of a new catalog; returns all that is found in them."""
    synced = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_id"))
    catalog.create_sources(
        synced.distinct().select(
            F.col("source_id").alias("id"), F.concat(F.lit("shop "), "source_id").alias("name"),
            F.lit("rest").alias("connector_type"), F.lit(None).cast("string").alias("host"),
            F.lit(None).cast("string").alias("database_name"), F.lit("http://shop").alias("base_url"),
        )
    )
    found = _discovered(spark, sf_dir)
    catalog.save_metadata(found, synced)
    return found


@query("catalog_after_crash", f"""
WITH found AS ({_STORED_FIELDS}),
counts AS (SELECT source_id, CAST(count(DISTINCT entity) AS INTEGER) AS entity_count FROM found GROUP BY source_id)
SELECT source_id, entity, name, position, entity_count FROM found JOIN counts USING (source_id)""")
def catalog_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync that wrote all its files and died before it was published: the catalog is as it was."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    found = _shops(spark, sf_dir, catalog)
    catalog.prepare_metadata(found.filter(F.col("position") == 1), found.select("source_id"))
    entities = catalog.entities().select("source_id", F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    return (
        catalog.sources().select(F.col("id").alias("source_id"), "entity_count").join(entities, "source_id")
        .join(catalog.fields().select("entity_id", "name", "position"), "entity_id", "left")
        .select("source_id", "entity", "name", "position", "entity_count")
    )


@query("save_tests_log", """
WITH t AS (
 SELECT event_type AS source_id, event_id, ts, event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k
 FROM events)
SELECT source_id, count(*) AS n_tests, max(CASE WHEN k = 1 THEN CASE WHEN ok THEN 'active' ELSE 'error' END END) AS status,
 max(CASE WHEN k = 1 AND NOT ok THEN 'HTTP ' || (500 + event_id % 7) END) AS error_message, max(ts) AS last_tested_at FROM t GROUP BY source_id""")
def save_tests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as connection tests, logged in nine batches by their id, one of which is sent twice; event types are the sources."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    events = table(spark, sf_dir, "events")
    catalog.create_sources(events.select("event_type").distinct().select(
        F.col("event_type").alias("id"), F.col("event_type").alias("name"), F.lit("rest").alias("connector_type"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("database_name"), F.lit("http://x").alias("base_url"),
    ))
    ok = F.col("event_id") % 3 != 0
    tests = events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_type").alias("source_id"), ok.alias("success"),
        F.when(ok, 5).cast("int").alias("latency_ms"), F.concat(F.lit("HTTP "), F.when(ok, 200).otherwise(500 + F.col("event_id") % 7)).alias("message"),
        F.col("ts").cast("timestamp").alias("tested_at"),
    )
    for batch in (0, 1, 2, 2, 3, 4, 5, 6, 7, 8):
        catalog.save_tests(tests.filter(F.pmod(F.col("id").cast("bigint"), F.lit(9)) == batch), ("events", batch))
    counts = catalog.connection_tests().groupBy("source_id").agg(F.count("*").alias("n_tests"))
    states = catalog.sources().select(F.col("id").alias("source_id"), "status", "error_message", F.col("last_tested_at").cast("timestamp_ntz").alias("last_tested_at"))
    return counts.join(states, "source_id").select("source_id", "n_tests", "status", "error_message", "last_tested_at")


@query("catalog_deep_page", """
SELECT 'order_' || o_orderkey AS name FROM orders WHERE o_orderpriority = '3-MEDIUM' ORDER BY 'order_' || o_orderkey LIMIT 50 OFFSET 150""")
def catalog_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of one source's entities, found by the counts stored with the catalog."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    _shops(spark, sf_dir, catalog)
    return catalog.entity_page("3-MEDIUM", 4, 50).select("name")


@query("entity_search_indexed", """
SELECT 'order_' || o_orderkey AS name FROM orders WHERE o_orderpriority = '2-HIGH' AND 'order_' || o_orderkey ILIKE '%DER_1%23%'
ORDER BY 'order_' || o_orderkey LIMIT 50""")
def entity_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search text with wildcards, of which the character triples are looked up before any name is read."""
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    _shops(spark, sf_dir, catalog)
    return catalog.search("2-HIGH", "DER_1%23").select("name")
