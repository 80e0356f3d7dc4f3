"""JSON bodies made of events and orders, unwrapped and typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.text import PAGE_MARK
from unisource.operators import records
from unisource.plans.queries.registry import payload, pick, query, table
from unisource.session import spread_small

# Two records of one event, in JSON and in SQL.
_FIRST = '{"event_id":%d,"kind":"%s","amount":%d}'
_SECOND = '{"event_id":%d,"kind":"twin","amount":%d}'


def _fill(template: str) -> Column:
    """A body around the two records."""
    first = F.format_string(_FIRST, "event_id", "event_type", "user_id")
    second = F.format_string(_SECOND, "event_id", F.col("user_id") + 1)
    return F.replace(F.replace(F.lit(template), F.lit("#1"), first), F.lit("#2"), second)


def _events(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    body = F.when(F.col("_m") == 0, _fill(templates[0]))
    for i, t in enumerate(templates[1:], 1):
        body = body.when(F.col("_m") == i, _fill(t))
    df = table(spark, sf_dir, "events").withColumn("_m", F.col("event_id") % len(templates))
    return payload(df, "events", F.lit("events"), F.col("event_id"), body)


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.try_variant_get("row", "$.event_id", "bigint").alias("event_id"),
        "row_no",
        F.try_variant_get("row", "$.kind", "string").alias("kind"),
        F.try_variant_get("row", "$.amount", "bigint").alias("amount"),
    )


def _rows_sql(n: int, both: list[int], first: list[int]) -> str:
    """Events whose number modulo n gives both records, or the first one only."""
    one = ", ".join(map(str, both + first))
    two = ", ".join(map(str, both))
    return f"""
SELECT event_id, CAST(0 AS INTEGER) AS row_no, event_type AS kind, user_id AS amount FROM events
WHERE event_id % {n} IN ({one})
UNION ALL
SELECT event_id, CAST(1 AS INTEGER), 'twin', user_id + 1 FROM events WHERE event_id % {n} IN ({two})"""


_BODIES = ["[#1,#2]", '{"meta":[],"data":[#1,#2]}', "#1", '{"n":2,"items":[#1,#2],"more":[#2]}', "7"]


@query("rest_rows", _rows_sql(5, [0, 3], [2]))
def rest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty first list of the second body form wins: it has no rows."""
    return _columns(records.rest_rows(_events(spark, sf_dir, _BODIES)))


@query("json_record_unwrap", _rows_sql(5, [0, 1, 3], [2]))
def json_record_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file rule passes the empty list over."""
    return _columns(records.file_records(_events(spark, sf_dir, _BODIES)))


@query("odata_rows", _rows_sql(4, [0, 3], [2]))
def odata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = ['{"@odata.context":"c","value":[#1,#2]}', '{"value":[]}', "#1", '{"value":[#1,#2],"@odata.count":2}']
    return _columns(records.odata_rows(_events(spark, sf_dir, bodies)))


def _value_body() -> Column:
    return F.concat(
        F.lit('{"id":'), F.col("event_id"), F.lit(',"at":"'), F.col("ts").cast("string"), F.lit('","value":'),
        F.col("value"), F.lit(',"even":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"props":'), "props",
        F.lit(',"none":null,"tags":['), F.col("user_id"), F.lit('],"kind":"'), "event_type",
        F.lit('","long":123456789012345678901,"exp":1e5,"whole":1.0}'),
    )


_VALUE_TYPES = [
    ("id", "integer"), ("at", "date"), ("value", "float"), ("even", "boolean"), ("props", "object"),
    ("none", "string"), ("tags", "array"), ("kind", "string"), ("long", "integer"), ("exp", "float"),
    ("whole", "float"),
]


@query("json_value_types", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS name, '{t}' AS type, count(*) AS n FROM events"
    for i, (n, t) in enumerate(_VALUE_TYPES)
))
def json_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spread_small(table(spark, sf_dir, "events"))
        .select(F.posexplode(J.shaped(J.entries(_value_body()))).alias("position", "_e"))
        .select(
            "position", F.col("_e.key").alias("name"), J.value_type(F.col("_e.value"), F.col("_e.shape")).alias("type")
        )
        .groupBy("position", "name", "type")
        .agg(F.count("*").alias("n"))
    )


def _order() -> Column:
    return F.format_string(
        '{"z_key":%d,"status":"%s","placed":"%s","total":%s,"a_flag":%s}',
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"),
        (F.col("o_orderkey") % 2 == 0).cast("string"),
    )


_ORDER_FIELDS = [
    ("z_key", "integer"), ("status", "string"), ("placed", "date"), ("total", "float"), ("a_flag", "boolean"),
]
_ORDER_VALUES = ", ".join(f"(CAST({i} AS INTEGER), '{n}', '{t}')" for i, (n, t) in enumerate(_ORDER_FIELDS))


@query("record_entity", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS path, 'order_' || o_custkey AS entity, f.position, f.name, f.type
FROM orders, (VALUES {_ORDER_VALUES}) AS f(position, name, type) WHERE o_orderkey % 4 IN (0, 1)
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 'order_' || o_custkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 = 2""")
def record_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of objects, objects, empty lists (no field) and lists of bare values (no entity)."""
    m = F.col("o_orderkey") % 4
    body = (
        F.when(m == 0, F.concat(F.lit("["), _order(), F.lit(',{"other":1}]')))
        .when(m == 1, _order()).when(m == 2, "[]").otherwise("[1,2]")
    )
    landed = payload(
        table(spark, sf_dir, "orders"), "orders", F.concat(F.lit("order_"), "o_custkey"), F.col("o_orderkey"), body
    )
    return records.endpoint_fields(landed).select("path", "entity", "position", "name", "type")


@query("json_file_fields", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS path,
 CASE o_orderkey % 3 WHEN 0 THEN 'JSON - 2 enregistrements, 5 champs' ELSE 'JSON - 1 enregistrements, 5 champs' END
   AS entity_description,
 f.position, f.name, f.type, 'json_field' AS native_type
FROM orders, (VALUES {_ORDER_VALUES}) AS f(position, name, type) WHERE o_orderkey % 3 IN (0, 1)
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 'JSON - 3 enregistrements, 0 champs', NULL, NULL, NULL, NULL
FROM orders WHERE o_orderkey % 3 = 2""")
def json_file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    body = (
        F.when(m == 0, F.concat(F.lit('{"none":[],"rows":['), _order(), F.lit(',{"x":1}]}')))
        .when(m == 1, _order()).otherwise('{"rows":[1,2,3]}')
    )
    landed = payload(table(spark, sf_dir, "orders"), "orders", F.lit("orders"), F.col("o_orderkey"), body)
    return records.json_file_fields(landed).select(
        "path", "entity_description", "position", "name", "type", "native_type"
    )


# The second record has the keys in another order, one of another type, one key more and an empty one.
_LATE = '{"a_flag":null,"status":7,"z_key":1.5,"late":["x"]}'
_ALL_FIELDS = [
    ("z_key", "string"), ("a_flag", "boolean"), ("status", "string"), ("placed", "date"), ("total", "float"), ("late", "array"),
]
_ALL_VALUES = ", ".join(f"(CAST({i} AS INTEGER), '{n}', '{t}')" for i, (n, t) in enumerate(_ALL_FIELDS))


@query("record_entity_all", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS path, 'order_' || o_custkey AS entity, f.position, f.name, f.type
FROM orders, (VALUES {_ALL_VALUES}) AS f(position, name, type) WHERE o_orderkey % 5 IN (0, 4)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_' || o_custkey, f.position, f.name, f.type
FROM orders, (VALUES {_ORDER_VALUES}) AS f(position, name, type) WHERE o_orderkey % 5 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_' || o_custkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 2""")
def record_entity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed from all records: lists whose later records differ, objects, empty lists, bare values, and one list over two pages."""
    m = F.col("o_orderkey") % 5
    both = F.concat(F.lit("[3,"), _order(), F.lit(f",{_LATE}]"))
    body = F.when(m == 0, both).when(m == 1, _order()).when(m == 2, "[]").when(m == 3, "[1,2]")
    orders = table(spark, sf_dir, "orders").withColumn("_page", F.explode(F.when(m == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    page = F.when(F.col("_page") == 1, F.concat(F.lit("["), _order(), F.lit("]"))).otherwise(f"[{_LATE}]")
    path = F.concat("o_orderkey", F.when(F.col("_page") > 1, F.concat(F.lit(PAGE_MARK), "_page")).otherwise(""))
    landed = payload(orders, "orders", F.concat(F.lit("order_"), "o_custkey"), path, F.coalesce(body, page))
    return records.endpoint_fields(landed, mode="all").select("path", "entity", "position", "name", "type")


@query("json_file_fields_all", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS path,
 CASE o_orderkey % 3 WHEN 0 THEN 'JSON - 3 enregistrements, 6 champs' ELSE 'JSON - 1 enregistrements, 5 champs' END AS entity_description,
 f.position, f.name, f.type, 'json_field' AS native_type
FROM orders, (SELECT 0 AS m, * FROM (VALUES {_ALL_VALUES}) UNION ALL SELECT 1, * FROM (VALUES {_ORDER_VALUES})) AS f(m, position, name, type)
WHERE o_orderkey % 3 = f.m
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'JSON - 3 enregistrements, 0 champs', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 2""")
def json_file_fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files typed from all records; one has a record that is no object, one has no other."""
    m = F.col("o_orderkey") % 3
    body = (
        F.when(m == 0, F.concat(F.lit('{"none":[],"rows":['), _order(), F.lit(f',"x",{_LATE}]}}')))
        .when(m == 1, _order()).otherwise('{"rows":[1,2,3]}')
    )
    landed = payload(table(spark, sf_dir, "orders"), "orders", F.lit("orders"), F.col("o_orderkey"), body)
    return records.json_file_fields(landed, mode="all").select("path", "entity_description", "position", "name", "type", "native_type")


@query("json_schema_all", """
SELECT event_type, name, CAST(min(position) AS INTEGER) AS position,
 CASE WHEN count(DISTINCT type) FILTER (type <> 'none') = 1 THEN min(type) FILTER (type <> 'none') ELSE 'string' END
   AS type,
 count(*) AS n_records, count(*) FILTER (type <> 'none') AS n_values
FROM (
 SELECT event_type, 'id' AS name, 0 AS position, 'integer' AS type FROM events
 UNION ALL SELECT event_type, 'mixed', 1, CASE event_id % 2 WHEN 0 THEN 'integer' ELSE 'float' END FROM events
 UNION ALL SELECT event_type, 'rare', 2, CASE event_id % 7 WHEN 0 THEN 'date' ELSE 'none' END FROM events
 UNION ALL SELECT event_type, 'late', 3, 'array' FROM events WHERE event_id % 3 = 0
) GROUP BY event_type, name""")
def json_schema_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types over all records of each event type, not only the first."""
    body = F.concat(
        F.lit('{"id":'), F.col("event_id"), F.lit(',"mixed":'), pick(["1", "1.5"], F.col("event_id") % 2),
        F.lit(',"rare":'), F.when(F.col("event_id") % 7 == 0, '"2024-02-03"').otherwise("null"),
        F.when(F.col("event_id") % 3 == 0, ',"late":[1]').otherwise(""), F.lit("}"),
    )
    events = spread_small(table(spark, sf_dir, "events"))
    return records.record_types(events.select("event_type", body.alias("body")), ["event_type"])
