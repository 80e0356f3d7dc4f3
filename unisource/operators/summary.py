"""Descriptions of file entities by their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_summary(df: DataFrame, entity: str) -> DataFrame:
    """Row and column count of a table of texts; without rows it has no fields and no description."""
    n_columns = len(df.columns)
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(entity).alias("entity"),
        "n_rows",
        F.when(F.col("n_rows") > 0, n_columns).otherwise(0).cast("bigint").alias("n_fields"),
        F.when(
            F.col("n_rows") > 0, F.format_string(f"CSV - %d lignes, {n_columns} colonnes", "n_rows")
        ).alias("description"),
    )
