"""Streaming runs of operators that work payload by payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from unisource import schemas
from unisource.operators import edmx, records, status
from unisource.plans.catalog import Catalog

PAYLOAD_OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rest_rows": records.rest_rows,
    "odata_rows": records.odata_rows,
    "edmx_fields": edmx.edmx_fields,
}


def stream_payloads(spark: SparkSession, folder: str, operator: str, max_files: int = 1000) -> DataFrame:
    """Rows or fields of payload files as they land; no state is kept."""
    landed = (
        spark.readStream.schema(schemas.LANDED).option("maxFilesPerTrigger", max_files).parquet(folder)
    )
    return PAYLOAD_OPERATORS[operator](landed)


def stream_latest_status(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Latest state per source from the growing test log; state is one row per source.

    Write it in update mode.
    """
    tests = (
        spark.readStream.schema(schemas.CONNECTION_TESTS).option("maxFilesPerTrigger", max_files).parquet(folder)
    )
    return status.latest_status(tests)


def stream_tests_into(
    spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, name: str = "tests", late: str = "1 day", max_files: int = 1000
) -> StreamingQuery:
    """Log the connection tests that have landed so far in a catalog and move its sources to their last state.

    A test that lands twice within `late` of event time counts once; the state kept for that is dropped behind the
    watermark. A batch that is run again after a failure was saved under its number and is left out, so every batch is
    in the catalog exactly once. A test older than its source's last one is logged and changes no state.
    """
    tests = (
        spark.readStream.schema(schemas.CONNECTION_TESTS).option("maxFilesPerTrigger", max_files).parquet(folder)
        .withWatermark("tested_at", late).dropDuplicatesWithinWatermark(["id"])
    )

    def save(batch: DataFrame, number: int) -> None:
        catalog.save_tests(batch, (name, number))

    return tests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what has landed so far into parquet files and stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
