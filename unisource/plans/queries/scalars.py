"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.functions import text
from unisource.plans.queries.registry import pick, query, table


@query("display_names", """
SELECT p_partkey, list_aggregate(list_transform(string_split(p_name || ' ' || p_type, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS display_name,
 lower(replace(p_name || ' ' || p_type, ' ', '_')) AS entity_name FROM part""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "p_name", "p_type")
    spaced = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.display_name(name).alias("display_name"),
        text.entity_name_from_source(spaced).alias("entity_name"),
    )


@query("endpoint_names", """
SELECT page_id, coalesce(nullif(trim(p, '/'), ''), 'data') AS live,
 coalesce(nullif(replace(trim(p, '/'), '/', '_'), ''), 'data') AS lib
FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '//' ELSE regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) END AS p
 FROM pages)""")
def endpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity names from the paths of page addresses."""
    path = F.when(F.col("page_id") % 9 == 0, "//").otherwise(F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("p")).select(
        "page_id", text.entity_name_from_path("p").alias("live"),
        text.entity_name_from_path("p", flatten=True).alias("lib"),
    )


@query("human_size", """
SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f o', s) WHEN s < 1048576 THEN printf('%.1f Ko', s / 1024)
 WHEN s < 1073741824 THEN printf('%.1f Mo', s / 1048576) WHEN s < 1099511627776 THEN printf('%.1f Go', s / 1073741824)
 ELSE printf('%.1f To', s / 1099511627776) END AS size
FROM (SELECT doc_id, CAST(n_chars * list_extract([1, 256, 65536, 16777216, 4294967296], CAST(doc_id % 5 AS INTEGER) + 1)
 AS DOUBLE) AS s FROM documents)""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths scaled over all units, with many ties at the second decimal."""
    scale = F.get(F.array(*[F.lit(x).cast("bigint") for x in (1, 256, 65536, 16777216, 4294967296)]),
                  (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * scale).alias("size"))


_FILES = ["C:\\Users\\x\\", "\\\\srv\\share\\", "//srv/share/", "/data/", "D:", "", None]


@query("resolve_paths", f"""
SELECT page_id, CASE page_id % 7
  WHEN 0 THEN '/mnt/host/Users/x/' || page_id || '.csv'
  WHEN 1 THEN '/mnt/network/srv/share/' || page_id || '.csv'
  WHEN 2 THEN '/mnt/network/srv/share/' || page_id || '.csv'
  WHEN 3 THEN '/data/' || page_id || '.csv'
  WHEN 4 THEN '/mnt/host/' || substr(page_id || '.csv', 2)
  ELSE CASE page_id % 3 WHEN 0 THEN '/up/' || page_id WHEN 1 THEN url ELSE '' END END AS path
FROM pages""")
def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows drives and shares, plain paths, and the fallbacks."""
    key = F.col("page_id")
    prefix = pick(_FILES, key % 7)
    file_path = F.when(key % 7 < 5, F.concat(prefix, key.cast("string"), F.lit(".csv"))).otherwise(prefix)
    uploaded = F.when(key % 3 == 0, F.concat(F.lit("/up/"), key))
    url = F.when(key % 3 < 2, F.col("url")).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", text.resolve_path(file_path, uploaded, url).alias("path"))


