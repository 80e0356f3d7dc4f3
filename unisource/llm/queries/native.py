"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.llm import decontaminate, quality, secrets
from unisource.llm.common import ids_and_texts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and the weakly supervised verdict of every document."""
    scored = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    m = F.col("quality.measures")
    return scored.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("quality.base_failed").alias("base_failed"), "kept", F.col("quality.probability").alias("probability"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, by pattern and by ownership."""
    found = secrets.secret_spans(ids_and_texts(read(spark, sf_dir, "documents"), "source"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.concat("base", "live")).alias("spans"), F.size("live").cast("long").alias("n_owned"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.contamination(
        ids_and_texts(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# The measures of op5 that do not depend on the corpus; not registered, and no test runs it yet.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], chr(1)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)
"""


def sql_spans(kind: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """Matches of one pattern by row, with their places."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, text, source, {kind} AS kind, v[i] AS val, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS b
  FROM (
    SELECT doc_id, text, source, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (
      SELECT doc_id, text, source, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_extract_all(text, '{quoted}', {group}) AS v,
        string_split_regex(text, '{quoted}') AS g
      FROM d WHERE regexp_matches(text, '{quoted}')
    )
  ) WHERE length(v[i]) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
base AS ({sql_spans(0, secrets.ASSIGN, 2, secrets.MIN_VALUE)} UNION ALL {sql_spans(1, secrets.ACCESS)} UNION ALL {sql_spans(2, secrets.HEX)}),
cand AS (
  SELECT * FROM ({sql_spans(3, secrets.CANDIDATE)}) c
  WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.b AND c.a < b.b)
),
few AS (
  SELECT val FROM (SELECT DISTINCT doc_id, source, val FROM (SELECT * FROM base UNION ALL SELECT * FROM cand)) GROUP BY val
  HAVING count(DISTINCT coalesce('s' || source, 'n')) <= {secrets.MAX_OWNERS} AND count(*) <= {secrets.MAX_REPOS}
),
everything AS (SELECT * FROM base UNION ALL SELECT cand.* FROM cand WHERE val IN (SELECT val FROM few)),
named AS (SELECT *, list_extract(['assign', 'access', 'hex', 'owned'], kind + 1) || ':' || a || ':' || b AS s FROM everything),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3), '') AS base, string_agg(s, ',' ORDER BY a, kind) AS spans,
    count(*) FILTER (kind = 3) AS n_owned
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN agg USING (doc_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = f"list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[k:k+m-1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0)
),
lens AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, m, k, array_to_string(ws[k:k+m-1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, lens WHERE len(ws) >= m)
),
hit AS (SELECT doc_id, item_id, k, dw.m AS m FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
