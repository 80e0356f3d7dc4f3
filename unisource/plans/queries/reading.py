"""Catalog reads with orders as entities and their lines as fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.operators import checks, pages, status
from unisource.operators.fields import dedup_fields
from unisource.plans.queries.registry import pick, query, sql_pick, table
from unisource.session import spread_small


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        pick(["database", "webservice", "file"], F.col("c_custkey") % 3).alias("category"),
        pick(["pending", "active", "error", "active"], F.col("c_custkey") % 4).alias("status"),
        F.col("c_custkey").alias("created_at"),
    )


_SOURCES_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS description,
 {sql_pick(["database", "webservice", "file"], "c_custkey % 3")} AS category,
 {sql_pick(["pending", "active", "error", "active"], "c_custkey % 4")} AS status, c_custkey AS created_at
FROM customer"""


@query("list_sources", f"""
SELECT * FROM ({_SOURCES_SQL})
WHERE category = 'webservice' AND status = 'active' AND (name ILIKE '%1_%5%' OR description ILIKE '%1_%5%')""")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three conditions; the search text holds wildcards."""
    return pages.list_sources(_sources(spark, sf_dir), "webservice", "active", "1_%5")


@query("get_source", f"""
SELECT * FROM ({_SOURCES_SQL}) WHERE id = '42'""")
def get_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.get_source(_sources(spark, sf_dir), "42")


@query("search_sources", f"""
SELECT * FROM ({_SOURCES_SQL}) WHERE name ILIKE '%house%' OR description ILIKE '%house%'""")
def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.list_sources(_sources(spark, sf_dir), search="house")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names repeat, so pages depend on the id as tie-break; some entities are hidden."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"),
        F.col("o_orderstatus").alias("source_id"),
        F.col("o_orderpriority").alias("name"),
        (F.col("o_totalprice") > 50000).alias("is_visible"),
    )


_ENTITIES_SQL = """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderstatus AS source_id, o_orderpriority AS name,
 o_totalprice > 50000 AS is_visible FROM orders"""
_PAGE_SQL = f"""
SELECT * FROM ({_ENTITIES_SQL}) WHERE is_visible AND source_id = 'F' AND name ILIKE '%e%'
ORDER BY name, id LIMIT 20 OFFSET 40"""


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.entity_page(_entities(spark, sf_dir), "F", page=3, page_size=20, search="E")


@query("entity_page", _PAGE_SQL)
def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir)


@query("entity_page_after", f"""
SELECT * FROM ({_ENTITIES_SQL}) WHERE is_visible AND (name > '3-MEDIUM' OR (name = '3-MEDIUM' AND id > '000000000500'))
ORDER BY name, id LIMIT 50""")
def entity_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.entity_page_after(_entities(spark, sf_dir), "3-MEDIUM", "000000000500")


@query("page_totals", f"""
SELECT CAST(999 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size, count(*) AS total_entities,
 CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages, 'e' AS search
FROM ({_ENTITIES_SQL}) WHERE is_visible AND source_id = 'F' AND name ILIKE '%e%'""")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals do not depend on the page asked for, here one past the end."""
    return pages.page_totals(_entities(spark, sf_dir), "F", page=999, page_size=20, search="e")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fields; a repeated line number is merged as on save."""
    lines = spread_small(table(spark, sf_dir, "lineitem")).select(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("entity_id"),
        F.concat(F.lit("line_"), "l_linenumber").alias("name"),
        F.col("l_linenumber").alias("position"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("version"),
        F.col("l_returnflag").alias("data_type"),
        F.col("l_partkey").cast("string").alias("native_type"),
    )
    merged = dedup_fields(lines, ["entity_id", "name", "position"], "version", ["data_type", "native_type"])
    return merged.drop("version").withColumns(
        {
            "display_name": F.lit(None).cast("string"), "is_nullable": F.lit(True),
            "is_primary_key": F.lit(False), "is_foreign_key": F.lit(False),
        }
    )


_FIELDS_SQL = """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS entity_id, 'line_' || l_linenumber AS name,
 l_linenumber AS position, r AS data_type, CAST(p AS VARCHAR) AS native_type
FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS r, l_partkey AS p,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1"""


@query("page_fields", f"""
SELECT entity_id, name, position, data_type, native_type FROM ({_FIELDS_SQL})
WHERE entity_id IN (SELECT id FROM ({_PAGE_SQL}))""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_fields(_fields(spark, sf_dir), _page(spark, sf_dir))
    return found.select("entity_id", "name", "position", "data_type", "native_type")


@query("entity_detail", f"""
SELECT e.id AS entity_id, e.name, CAST(count(f.name) AS BIGINT) AS field_count,
 coalesce(string_agg(f.name || ':' || f.data_type || ':' || f.native_type, ',' ORDER BY f.position), '') AS field_list
FROM ({_ENTITIES_SQL}) e LEFT JOIN ({_FIELDS_SQL}) f ON f.entity_id = e.id GROUP BY e.id, e.name""")
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with its nested fields; those without keep an empty list."""
    detail = pages.entity_detail(_entities(spark, sf_dir), _fields(spark, sf_dir))
    listed = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["data_type"], f["native_type"]))
    return detail.select("entity_id", "name", "field_count", F.array_join(listed, ",").alias("field_list"))


@query("latest_status", """
SELECT CAST(user_id AS VARCHAR) AS source_id, CASE WHEN event_type <> 'error' THEN 'active' ELSE 'error' END AS status,
 CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) END AS test_latency_ms,
 CASE WHEN event_type = 'error' THEN props END AS error_message, ts AS last_tested_at
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source_id"),
        (F.col("event_type") != "error").alias("success"), F.floor("value").cast("int").alias("latency_ms"),
        F.col("props").alias("message"), F.col("ts").alias("tested_at"),
    )
    return status.latest_status(tests)


_KINDS = ["rest", "odata", "graphql", "soap", "sap_odata", "sage_x3", "dynamics365", "sage_cloud", "file"]
_LABELS = ["HTTP", "HTTP", "HTTP", "HTTP", "SAP OData HTTP", "SAGE X3 HTTP", "Dynamics 365 HTTP", "SAGE Cloud HTTP", "Fichier accessible (HTTP"]


@query("status_rules", f"""
SELECT event_id, kind, status, success,
 CASE WHEN status IS NULL THEN 'no answer' WHEN success THEN label || ' ' || status || CASE kind WHEN 'file' THEN ')' ELSE '' END ELSE 'HTTP ' || status END AS message
FROM (SELECT *, coalesce(status < CASE WHEN kind IN ('dynamics365', 'sage_cloud', 'file') THEN 400 ELSE 500 END, false)
  AS success
 FROM (SELECT event_id, {sql_pick(_KINDS, "event_id % 9")} AS kind, {sql_pick(_LABELS, "event_id % 9")} AS label,
   CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(200 + 100 * (event_id % 5) AS INTEGER) END AS status FROM events))""")
def status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    answers = table(spark, sf_dir, "events").select(
        "event_id", pick(_KINDS, key % 9).alias("kind"),
        F.when(key % 11 != 0, (200 + 100 * (key % 5)).cast("int")).alias("status"),
    )
    return status.status_rules(answers).select("event_id", "kind", "status", "success", "message")


@query("catalog_integrity", """
SELECT 'field name unique in entity' AS rule, count(*) AS n_violations FROM (
 SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'field position unique in entity', count(*) FROM (
 SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'field has entity', count(*) FROM lineitem
 WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'entity text length', count(*) FROM orders
 WHERE o_orderstatus <> 'P' AND length(repeat(o_orderpriority, 20)) > 255
UNION ALL SELECT 'field text length', count(*) FROM lineitem WHERE length(repeat(CAST(l_partkey AS VARCHAR), 30)) > 100""")
def catalog_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated names and positions, fields of missing entities (pending orders), overlong texts."""
    entities = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("id"), F.repeat("o_orderpriority", F.lit(20)).alias("name")
    )
    fields = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.concat(F.lit("line_"), "l_linenumber").alias("name"),
        F.col("l_partkey").alias("position"),
        F.repeat(F.col("l_partkey").cast("string"), F.lit(30)).alias("native_type"),
    )
    return checks.catalog_integrity(entities, fields)
