"""Column type votes, CSV profiles and file summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.functions.text import SPACES, display_name
from unisource.operators.infer import infer_columns
from unisource.operators.summary import csv_summary
from unisource.plans.queries.registry import query, table
from unisource.session import scratch_path
from unisource.sources.files import csv_fields, preview_head, read_csv

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def vote_sql(name: str) -> str:
    """One SELECT per column: filled values, matches of each pattern, and the ladder."""
    parts = []
    for i, c in enumerate(COLUMNS[name]):
        parts.append(
            f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name,
 CASE WHEN n_date / n_values > 0.8 THEN 'date' WHEN n_boolean / n_values > 0.8 THEN 'boolean'
      WHEN n_integer / n_values > 0.8 THEN 'integer' WHEN n_float / n_values > 0.8 THEN 'float'
      ELSE 'string' END AS type,
 (SELECT count(*) FROM {name}) AS n_cells, CAST(n_values AS BIGINT) AS n_values, CAST(n_integer AS BIGINT) AS n_integer, CAST(n_float AS BIGINT) AS n_float,
 CAST(n_date AS BIGINT) AS n_date, CAST(n_boolean AS BIGINT) AS n_boolean
FROM (SELECT CAST(count(*) AS DOUBLE) AS n_values,
 CAST(count(*) FILTER (regexp_full_match(v, '-?[0-9]+')) AS DOUBLE) AS n_integer,
 CAST(count(*) FILTER (regexp_full_match(v, '-?[0-9]+\\.[0-9]+')) AS DOUBLE) AS n_float,
 CAST(count(*) FILTER (regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS DOUBLE) AS n_date,
 CAST(count(*) FILTER (lower(v) IN ('true', 'false', '1', '0', 'oui', 'non')) AS DOUBLE) AS n_boolean
 FROM (SELECT trim(CAST({c} AS VARCHAR), '{SPACES}') AS v FROM {name}
       WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''))"""
        )
    return "\nUNION ALL\n".join(parts)


def _vote(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return infer_columns(table(spark, sf_dir, name))

    return run


for _name in ("lineitem", "customer", "orders", "events", "documents"):
    query(f"infer_types_{_name}", vote_sql(_name))(_vote(_name))


@query("catalog_lineitem", f"""
SELECT 'lineitem' AS entity, position, name, {"CASE name " + " ".join(
    f"WHEN '{c}' THEN '{c[0].upper()} {c[2:].title()}'" for c in COLUMNS["lineitem"]) + " END"} AS display_name,
 type AS data_type, 'csv_column' AS native_type
FROM ({vote_sql("lineitem")})""")
def catalog_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rows of a table of texts: inferred types and display names."""
    return infer_columns(table(spark, sf_dir, "lineitem")).select(
        F.lit("lineitem").alias("entity"), "position", "name", display_name("name").alias("display_name"),
        F.col("type").alias("data_type"), F.lit("csv_column").alias("native_type"),
    )


@query("csv_scan_profile", f"""
SELECT position, name, type,
 (SELECT format('CSV - {{}} lignes, 6 colonnes', count(*)) FROM part) AS entity_description
FROM ({vote_sql("part")})""")
def csv_scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a table as CSV into the shared folder, then profile the files in full."""
    path = scratch_path(spark, "csv-part")
    table(spark, sf_dir, "part").write.option("header", True).option("escape", '"').csv(path)
    return csv_fields(spark, path, "part", sample=None).select("position", "name", "type", "entity_description")


@query("csv_default_profile", """
SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'late', 'string'), (CAST(1 AS INTEGER), 'id', 'integer')) AS f(position, name, type)""")
def csv_default_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column whose first rows are numbers only, decided by all rows."""
    path = scratch_path(spark, "csv-orders")
    key = F.col("o_orderkey")
    late = F.when(key < 1000, (key + 10).cast("string")).otherwise(F.col("o_orderstatus"))
    table(spark, sf_dir, "orders").select(late.alias("late"), (key + 10).alias("id")).write.option("header", True).csv(path)
    return csv_fields(spark, path, "orders").select("position", "name", "type")


@query("csv_multiline_split", """
SELECT doc_id, md5(text) AS text_md5, lang FROM documents WHERE text IS NOT NULL""")
def csv_multiline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV, their line breaks within quotes, each file read by as many tasks as it has splits."""
    path = scratch_path(spark, "csv-one")
    documents = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "lang")
    documents.write.options(header=True, escape='"', quoteAll=True, lineSep="\n", emptyValue="").csv(path)
    rows = read_csv(spark, path).rows()
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang")


@query("csv_rows", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts with quotes, commas and line ends through a CSV file and back."""
    path = scratch_path(spark, "csv-documents")
    table(spark, sf_dir, "documents").write.option("header", True).option("escape", "\"").options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).option(
        "emptyValue", ""
    ).csv(path)
    return read_csv(spark, path).rows().select("doc_id", "text", "lang", "n_chars")


@query("file_summary", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS entity, count(*) AS n_rows, CAST({len(c)} AS BIGINT) AS n_fields, "
    f"format('CSV - {{}} lignes, {len(c)} colonnes', count(*)) AS description FROM {t}"
    for t, c in COLUMNS.items()
))
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [csv_summary(table(spark, sf_dir, t), t) for t in COLUMNS])


@query("preview_head", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return preview_head(df, ["o_orderkey"])
