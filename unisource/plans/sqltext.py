"""SQL text with named parameters over registered entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(entities: dict[str, DataFrame]) -> None:
    """Make entities known by name to later queries."""
    for name, df in entities.items():
        df.createOrReplaceTempView(name)


def execute_query(
    spark: SparkSession, query: str, params: dict | None = None, entities: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Rows of a query with `:name` parameters, as a lazy DataFrame.

    Values are bound as literals, never pasted into the text.
    """
    if entities:
        register(entities)
    return spark.sql(query, args=params or {})
