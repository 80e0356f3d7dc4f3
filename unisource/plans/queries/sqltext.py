"""SQL text with named parameters over the registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unisource.plans.queries.registry import query, table
from unisource.plans.sqltext import execute_query


def _run(spark: SparkSession, sf_dir: str, names: list[str], text: str, **params) -> DataFrame:
    return execute_query(spark, text, params, {n: table(spark, sf_dir, n) for n in names})


_TOP = """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = {segment} AND o_totalprice > {price} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"""


@query("param_query", _TOP.format(segment="'MACHINERY'", price="1000"))
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top orders of a segment; the values are bound, not pasted."""
    return _run(
        spark, sf_dir, ["customer", "orders"], _TOP.format(segment=":segment", price=":price"),
        segment="MACHINERY", price=1000,
    )


# Inner, outer, semi and anti joins, and a range join over a four-row table of bounds.
_JOINS = """
SELECT 'inner' AS kind, n_name AS label, CAST(count(*) AS BIGINT) AS n
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT 'left', c_mktsegment, CAST(count(o_orderkey) AS BIGINT)
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_mktsegment
UNION ALL SELECT 'semi', c_mktsegment, CAST(count(*) AS BIGINT) FROM customer
 WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment
UNION ALL SELECT 'anti', c_mktsegment, CAST(count(*) AS BIGINT) FROM customer
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment
UNION ALL SELECT 'range', b.label, CAST(count(*) AS BIGINT)
 FROM part JOIN (VALUES ('low', 0, 10), ('mid', 11, 30), ('high', 31, 100)) AS b(label, lo, hi)
  ON p_size BETWEEN b.lo AND b.hi GROUP BY b.label"""


@query("sql_joins", _JOINS)
def sql_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["customer", "nation", "orders", "part"], _JOINS)


_GROUPING = """
SELECT 'rollup' AS kind, l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_suppliers
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT 'cube', o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT), CAST(min(o_custkey) AS BIGINT),
 CAST(max(o_custkey) AS BIGINT) FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL SELECT 'sets', p_brand, p_type, CAST(count(*) AS BIGINT), CAST(sum(p_size) AS BIGINT),
 CAST(count(DISTINCT p_name) AS BIGINT) FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())"""


@query("sql_grouping", _GROUPING)
def sql_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["lineitem", "orders", "part"], _GROUPING)


_WINDOWS = """
SELECT o_orderkey, o_custkey,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth,
 CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rank_no,
 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous,
 CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
  AS BIGINT) AS recent
FROM orders"""


@query("sql_windows", _WINDOWS)
def sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["orders"], _WINDOWS)


_SETOPS = """
SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)"""


@query("sql_setops", _SETOPS)
def sql_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["customer", "supplier", "orders"], _SETOPS)
