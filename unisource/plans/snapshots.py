"""Snapshots of several tables below one folder: what belongs to a state is named by one manifest.

Writers only add files. A change becomes visible when its manifest, one small file, is renamed to its place by the
commit of Spark's own writer; until then nothing reads what was written. So a change of several tables is there as a
whole or not at all, and a job that dies leaves the state before it.

Tables are either lists of segments, to which changes add (`add`), or sets of buckets, which changes replace. Segments
are merged eight at a time into ones of the next level, so their number grows with the logarithm of the changes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MERGED = 8  # segments of a level that become one of the next
_MANIFEST = "writer string, table string, number int, path string, version bigint"
_WRITER = "\x00writer"


class ConcurrentChange(RuntimeError):
    """Another writer published the version after the one this change was made for."""


def bucket_of(source_id: Column | str) -> Column:
    """Bucket of a source; `bucket_number` is the same for a known id."""
    column = F.col(source_id) if isinstance(source_id, str) else source_id
    return F.coalesce(F.crc32(column.cast("binary")) % BUCKETS, F.lit(0)).cast("int")


def bucket_number(source_id: str) -> int:
    return zlib.crc32(source_id.encode()) % BUCKETS


@dataclass
class Snapshot:
    """Paths by table and number: a bucket's number, or a segment's in the order of the changes."""

    version: int = 0
    tables: dict[str, dict[int, str]] = field(default_factory=dict)

    def paths(self, table: str) -> list[str]:
        return [path for _, path in sorted(self.tables.get(table, {}).items())]


#: By table and number the new path, or None for one that goes.
Changes = dict[str, dict[int, str | None]]


def level_of(path: str) -> int:
    found = re.search(r"/level-(\d+)-[^/]*$", path)
    return int(found[1]) if found else 0


class Snapshots:
    """The manifests of one folder. One writer at a time is meant; a second one is noticed and has to begin again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests").select("*", "_metadata.file_modification_time")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def latest(self) -> Snapshot:
        """The state of the last published version; of two manifests for one version the first one counts."""
        stored = self._manifests()
        version = stored.agg(F.max("version")).first()[0] if stored is not None else None
        if version is None:
            return Snapshot()
        snapshot = Snapshot(version)
        writer = self._winner(stored, version)
        for r in stored.filter((F.col("version") == version) & (F.col("writer") == writer) & (F.col("table") != _WRITER)).collect():
            snapshot.tables.setdefault(r["table"], {})[r["number"]] = r["path"]
        return snapshot

    def _winner(self, stored: DataFrame, version: int) -> str:
        own = stored.filter((F.col("version") == version) & (F.col("table") == _WRITER))
        return own.orderBy("file_modification_time", "writer").first()["writer"]

    def new_path(self, table: str, level: int = 0) -> str:
        return f"{self.root}/data/{table}/level-{level}-{uuid.uuid4().hex}"

    def publish(self, base: Snapshot, changes: Changes) -> Snapshot:
        """Make the changes the version after `base`, by one new file."""
        tables = {t: dict(own) for t, own in base.tables.items()}
        for table, own in changes.items():
            held = tables.setdefault(table, {})
            for number, path in own.items():
                if path is None:
                    held.pop(number, None)
                else:
                    held[number] = path
        writer, version = uuid.uuid4().hex, base.version + 1
        rows = [(writer, t, n, p, version) for t, own in tables.items() for n, p in own.items()]
        manifest = self.spark.createDataFrame([(writer, _WRITER, 0, "", version), *rows], _MANIFEST)
        manifest.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.root}/manifests")
        if self._winner(self._manifests(), version) != writer:
            raise ConcurrentChange(f"version {version} was published by another writer")
        return Snapshot(version, tables)

    def read(self, snapshot: Snapshot, table: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets."""
        own = snapshot.tables.get(table, {})
        paths = snapshot.paths(table) if numbers is None else [own[n] for n in numbers if n in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, snapshot: Snapshot, table: str, rows: DataFrame, schema: str, merge: Callable[[DataFrame], DataFrame]) -> Changes:
        """A new segment; eight of a level are merged into one, by `merge` where they hold rows that replace each other."""
        path = self.new_path(table)
        rows.write.parquet(path)
        held = dict(snapshot.tables.get(table, {}))
        number = max(held, default=-1) + 1
        own: dict[int, str | None] = {number: path}
        held[number] = path
        level = 0
        while len(same := [n for n, p in sorted(held.items()) if level_of(p) == level]) >= MERGED:
            merged = self.new_path(table, level + 1)
            merge(self.spark.read.schema(schema).parquet(*[held[n] for n in same])).write.parquet(merged)
            for n in same:
                del held[n]
                own[n] = None
            held[same[0]] = own[same[0]] = merged
            level += 1
        return {table: own}

    def replace(self, snapshot: Snapshot, table: str, rows: DataFrame, schema: str, owners: DataFrame, order: list[str]) -> Changes:
        """The rows of `owners` (`source_id`) become `rows`; other sources of their buckets keep theirs.

        Files are sorted by `order`. A bucket is rebuilt by as many tasks as its size asks for.
        """
        ids = owners.select("source_id").distinct()
        touched = sorted(r[0] for r in ids.select(bucket_of("source_id")).distinct().collect())  # BUCKETS rows at most
        names = [c.split()[0] for c in schema.split(", ")]
        kept = self.read(snapshot, table, schema, touched).join(ids, "source_id", "left_anti").select(*names)
        new = rows.select(*names).join(ids, "source_id", "left_semi").select(*names)
        path = self.new_path(table)
        placed = new.unionByName(kept).withColumn("bucket", bucket_of("source_id"))
        placed.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        present = {r[0] for r in self.spark.read.schema(f"{schema}, bucket int").parquet(path).select("bucket").distinct().collect()}
        return {table: {n: f"{path}/bucket={n}" if n in present else None for n in touched}}
