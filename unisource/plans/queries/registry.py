"""Where queries and their SQL are collected, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.session import spread_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload(df: DataFrame, source: Column | str, hint: Column, path: Column, body: Column, status: Column | int = 200) -> DataFrame:
    """Landed payloads made row by row of a table; a small table is spread over the cores first."""
    return spread_small(df).select(
        (F.lit(source) if isinstance(source, str) else source.cast("string")).alias("source_id"),
        F.lit("").alias("dialect"),
        hint.cast("string").alias("entity_hint"),
        path.cast("string").alias("path"),
        (F.lit(status) if isinstance(status, int) else status).cast("int").alias("status"),
        body.alias("body"),
    )


def pick(names: list, index: Column) -> Column:
    """One of a few fixed texts by a row's number."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def sql_pick(names: list[str], index: str) -> str:
    listed = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"list_extract([{listed}], CAST({index} AS INTEGER) + 1)"
