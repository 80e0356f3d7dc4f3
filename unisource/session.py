"""Session helpers shared by operators, queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit every job of this package. They are defaults for sessions we
# build ourselves; an existing session is never changed.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.python.filterPushdown.enabled": "true",
}

# A small scan is spread over the cores with one cheap exchange, as far as every part
# keeps about SPREAD_BYTES of stored data.
SPREAD_BYTES = 128 << 10
# What is made of a row may be far larger than the row, so a part has no more stored data than this.
PART_BYTES = 4 << 20
# The optimizer takes tables of which it knows nothing for 8 EiB; such sizes are not to be split by.
UNKNOWN_BYTES = 1 << 50


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting falls back to a fresh temporary
    folder: there driver and executors are the same machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="unisource-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Compute once: write to a new folder below the shared one and read it back.

    What follows reads the same rows each time, only the columns it needs, and survives
    lost executors. The folder is scratch space, to be cleared by the cluster's own rules.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so once the driver's JVM has collected their plans as garbage, which a driver with memory to spare puts off
    while the files of one job after another fill the executors' disks.
    """
    spark.sparkContext._jvm.System.gc()


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a small, badly split input, and parts of bounded size for any.

    One unsplittable file would leave all work to one task, and parts that grow with the input
    would need ever more memory each. The size comes from the optimizer's statistics; without any the parts stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return df
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES), size // PART_BYTES)
    return df.repartition(parts) if parts > 1 else df
