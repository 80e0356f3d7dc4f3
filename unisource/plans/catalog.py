"""The catalog as stored tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource import schemas
from unisource.operators import changes, fields, pages, status
from unisource.plans.snapshots import Changes, Snapshot, Snapshots, bucket_number, bucket_of
from unisource.session import staged

_BY_SOURCE = {"entities": schemas.ENTITIES, "fields": schemas.FIELDS, "relations": schemas.RELATIONS}
_ORDER = {"entities": ["source_id", "name", "id"], "fields": ["source_id", "entity_id", "position"], "relations": ["source_id", "id"]}
_VERSIONED = schemas.SOURCES + ", is_deleted boolean, version bigint"
# How many visible entities of a source each file of `entities` holds, and the first of them.
_FILES = "source_id string, file string, n bigint, name string, id string"
# Which visible entities have three characters in a row in their lower-cased name: the file that holds them and their row in it.
_GRAMS = "source_id string, gram string, file string, row bigint"
GRAM = 3
SPELLED = 100_000  # names of which a task lists the triples


def pattern_grams(text: str) -> list[str]:
    """Three characters in a row that every name has which the search pattern matches.

    Wildcards match anything, and letters beyond ASCII may change their number when lower-cased; neither is in one. A
    backslash makes the next character plain: such a pattern has none at all.
    """
    if "\\" in text:
        return []
    runs = re.split(r"[%_]|[^\x00-\x7f]", text.lower())
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Catalog:
    """Catalog tables below one shared folder.

    Every change of whatever tables is one snapshot (see `snapshots`). `sources` and `connection_tests` are lists of
    segments: a change of a source adds its new version, reading keeps the latest. `entities`, `fields` and
    `relations` are buckets of sources, and a sync replaces the buckets of its sources. Files of `entities` are sorted and
    counted, so that a page opens the files that hold it, and their names' character triples are listed, so that a
    search opens the files that can match.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.snapshots = Snapshots(spark, root)

    # ---- reading ----

    def sources(self, snapshot: Snapshot | None = None) -> DataFrame:
        stored = self.snapshots.read(snapshot or self.snapshots.latest(), "sources", _VERSIONED)
        latest = changes.upsert_latest(stored, ["id"], ["version"])
        return latest.filter(~F.col("is_deleted")).drop("is_deleted", "version")

    def _by_source(self, table: str, source_id: str | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of all sources, or those of one, for which only its bucket is read."""
        snapshot = snapshot or self.snapshots.latest()
        if source_id is None:
            return self.snapshots.read(snapshot, table, _BY_SOURCE[table])
        return self.snapshots.read(snapshot, table, _BY_SOURCE[table], [bucket_number(source_id)]).filter(F.col("source_id") == source_id)

    def entities(self, source_id: str | None = None) -> DataFrame:
        return self._by_source("entities", source_id)

    def fields(self, source_id: str | None = None) -> DataFrame:
        return self._by_source("fields", source_id)

    def relations(self, source_id: str | None = None) -> DataFrame:
        return self._by_source("relations", source_id)

    def connection_tests(self) -> DataFrame:
        """The test log without the tests of deleted sources."""
        snapshot = self.snapshots.latest()
        log = self.snapshots.read(snapshot, "connection_tests", schemas.CONNECTION_TESTS)
        return log.join(self.sources(snapshot).select(F.col("id").alias("source_id")), "source_id", "left_semi")

    def entity_page(
        self, source_id: str, page: int = 1, page_size: int = pages.DEFAULT_PAGE_SIZE, snapshot: Snapshot | None = None
    ) -> DataFrame:
        """One page of a source's visible entities by name, at the same cost wherever it lies.

        The counts of the source's files, a few numbers each, say which files hold the page; no other one is opened.
        """
        pages.check_page(page, page_size)
        snapshot = snapshot or self.snapshots.latest()
        counted = self.snapshots.read(snapshot, "entity_files", _FILES, [bucket_number(source_id)]).filter(F.col("source_id") == source_id)
        offset, before, chosen, skipped = (page - 1) * page_size, 0, [], 0
        for r in counted.orderBy("name", "id").collect():
            if before + r["n"] <= offset:
                skipped = before + r["n"]
            elif before < offset + page_size:
                chosen.append(r["file"])
            before += r["n"]
        if not chosen:
            return self.spark.createDataFrame([], schemas.ENTITIES)
        rows = self.spark.read.schema(schemas.ENTITIES).parquet(*chosen)
        return pages.visible_entities(rows, source_id).orderBy("name", "id").offset(offset - skipped).limit(page_size)

    def search(
        self, source_id: str, text: str, page: int = 1, page_size: int = pages.DEFAULT_PAGE_SIZE, snapshot: Snapshot | None = None
    ) -> DataFrame:
        """One page of a source's visible entities whose name matches, like `pages.entity_page` with a search text.

        Only entities that have all character triples of the text are read and compared. A text without any, such
        as one of two characters, is compared with all names of the source.
        """
        snapshot = snapshot or self.snapshots.latest()
        grams = pattern_grams(text)
        if not grams:
            return pages.entity_page(self._by_source("entities", source_id, snapshot), source_id, page, page_size, text)
        listed = self.snapshots.read(snapshot, "entity_grams", _GRAMS, [bucket_number(source_id)])
        own = listed.filter((F.col("source_id") == source_id) & F.col("gram").isin(grams))
        hits = staged(own.groupBy("file", "row").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("file", "row"), "hits")
        files = [r["file"] for r in hits.select("file").distinct().collect()]  # files of one bucket
        if not files:
            return self.spark.createDataFrame([], schemas.ENTITIES)
        rows = self._placed_entities(files).join(hits, ["file", "row"], "left_semi")
        return pages.entity_page(rows.select(*_names(schemas.ENTITIES)), source_id, page, page_size, text)

    def detail(self, source_id: str, page: int = 1, page_size: int = pages.DEFAULT_PAGE_SIZE, search: str = "") -> DataFrame:
        """One page of a source's entities with their fields nested."""
        snapshot = self.snapshots.latest()
        if search:
            chosen = self.search(source_id, search, page, page_size, snapshot)
        else:
            chosen = self.entity_page(source_id, page, page_size, snapshot)
        ids = chosen.select(F.col("id").alias("entity_id"))
        own = self._by_source("fields", source_id, snapshot).join(ids, "entity_id", "left_semi")
        return pages.entity_detail(chosen, own).orderBy("name", "entity_id", "part")

    # ---- writing ----

    def _publish(self, snapshot: Snapshot, parts: Iterable[Changes]) -> None:
        self.snapshots.publish(snapshot, {table: own for part in parts for table, own in part.items()})

    def _versions(self, snapshot: Snapshot, rows: DataFrame, deleted: bool = False) -> Changes:
        """A segment with new versions of sources, numbered by the snapshot that will name it."""
        versioned = rows.withColumn("is_deleted", F.lit(deleted)).withColumn("version", F.lit(snapshot.version + 1).cast("bigint"))
        return self.snapshots.add(
            snapshot, "sources", versioned.select(*_names(_VERSIONED)), _VERSIONED, lambda rows: changes.upsert_latest(rows, ["id"], ["version"])
        )

    def create_sources(self, requests: DataFrame) -> DataFrame:
        """Add the requests that meet the rules; returns the others with their errors."""
        snapshot = self.snapshots.latest()
        accepted, refused = changes.new_sources(requests)
        self._publish(snapshot, [self._versions(snapshot, accepted)])
        return refused

    def update_sources(self, patches: DataFrame, order_by: str | None = None) -> None:
        """Patch sources by id. Several patches of one source count as one; by the column `order_by` the last one wins where they differ."""
        snapshot = self.snapshots.latest()
        touched = self.sources(snapshot).join(patches.select("id").distinct(), "id", "left_semi")
        self._publish(snapshot, [self._versions(snapshot, changes.partial_update(touched, patches, order_by=order_by))])

    def _placed_entities(self, paths: list[str]) -> DataFrame:
        """Rows of entity files with their file and their row in it; files never change."""
        rows = self.spark.read.schema(schemas.ENTITIES).parquet(*paths)
        return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def _replaced(self, snapshot: Snapshot, table: str, rows: DataFrame, synced: DataFrame) -> list[Changes]:
        """Changes that make `rows` all there is of the synced sources; entities are counted file by file."""
        change = self.snapshots.replace(snapshot, table, rows, _BY_SOURCE[table], synced, _ORDER[table])
        if table != "entities":
            return [change]
        paths = [p for p in change[table].values() if p]
        if not paths:
            return [change, *({t: dict.fromkeys(change[table])} for t in ("entity_files", "entity_grams"))]
        stored = pages.visible_entities(self._placed_entities(paths))
        first = F.min(F.struct("name", "id")).alias("first")
        counted = stored.groupBy("source_id", "file").agg(F.count("*").alias("n"), first).select("source_id", "file", "n", "first.name", "first.id")
        name = F.lower("name")
        places = F.when(F.length(name) >= GRAM, F.sequence(F.lit(1), F.length(name) - GRAM + 1))
        grams = F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(GRAM))))
        # names are dealt out, a bounded number to a task, and spelled there: triples are many times as many, and one
        # that all names have would meet in one task
        parts = stored.count() // SPELLED + 1
        dealt = stored.select("source_id", "name", "file", "row", bucket_of("source_id").alias("bucket")).repartitionByRange(parts, "bucket", "file", "row")
        spelled = dealt.select("source_id", F.explode(grams).alias("gram"), "file", "row", "bucket")
        files = counted.withColumn("bucket", bucket_of("source_id")).repartitionByRange("bucket", "source_id", "name")
        return [
            change, self._beside("entity_files", files, _FILES, change[table], ["source_id", "name"]),
            self._beside("entity_grams", spelled, _GRAMS, change[table], ["source_id", "gram"]),
        ]

    def _beside(self, table: str, rows: DataFrame, schema: str, touched: dict[int, str | None], order: list[str]) -> Changes:
        """What is kept beside the entities of some buckets; each task's rows are sorted."""
        path = self.snapshots.new_path(table)
        rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        held = {r[0] for r in self.spark.read.schema(f"{schema}, bucket int").parquet(path).select("bucket").distinct().collect()}
        return {table: {n: f"{path}/bucket={n}" if n in held else None for n in touched}}

    def prepare_metadata(self, discovered: DataFrame, synced: DataFrame, relations: DataFrame | None = None) -> tuple[Snapshot, list[Changes]]:
        """Write all that a sync changes, without making any of it visible."""
        snapshot = self.snapshots.latest()
        discovered = staged(discovered, "discovered")
        # computed once; its size is known then, so few sources are met without dealing all rows out by source
        synced = staged(synced.select("source_id").distinct(), "synced")
        parts = self._replaced(snapshot, "fields", fields.to_fields(discovered), synced)
        parts += self._replaced(snapshot, "entities", fields.to_entities(discovered), synced)
        if relations is not None:
            parts += self._replaced(snapshot, "relations", relations, synced)
        counts = fields.sync_summary(discovered).select(
            F.col("source_id").alias("id"), F.col("entity_count").cast("int").alias("_n")
        )
        ids = synced.select(F.col("source_id").alias("id"))
        now = F.current_timestamp()
        rows = (
            self.sources(snapshot).join(ids, "id", "left_semi").join(counts, "id", "left")
            .withColumn("entity_count", F.coalesce("_n", F.lit(0)))
            .withColumn("last_synced_at", now)
            .withColumn("updated_at", now)
            .drop("_n")
        )
        return snapshot, [*parts, self._versions(snapshot, rows)]

    def save_metadata(self, discovered: DataFrame, synced: DataFrame, relations: DataFrame | None = None) -> None:
        """Make `discovered` the whole metadata of the sources in `synced` (`source_id`).

        Entities, fields, relations and the sources' new counts become visible together; a sync that dies on the way
        leaves everything as it was. Rows of other sources are left out.
        """
        self._publish(*self.prepare_metadata(discovered, synced, relations))

    def save_tests(self, tests: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Log connection tests and move their sources to the state of the last one.

        A batch that arrives late, with tests from before a source's last one, is logged only. `batch` is the name of a stream
        and the number of its batch: one that was saved before is left out, and False comes back.
        """
        snapshot = self.snapshots.latest()
        mark: Changes = {}
        if batch is not None:
            name, number = f"batch/{batch[0]}", batch[1]
            if int(snapshot.tables.get(name, {}).get(0, "-1")) >= number:
                return False
            mark = {name: {0: str(number)}}
        tests = staged(tests, "tests")
        log = self.snapshots.add(
            snapshot, "connection_tests", tests.select(*_names(schemas.CONNECTION_TESTS)), schemas.CONNECTION_TESTS, lambda rows: rows
        )
        latest = status.latest_status(tests).withColumnRenamed("source_id", "id")
        names = ["status", "test_latency_ms", "error_message", "last_tested_at"]
        known = self.sources(snapshot).withColumn("_before", F.col("last_tested_at")).drop(*names)
        moved = F.col("_before").isNull() | (F.col("last_tested_at") >= F.col("_before"))
        rows = known.join(latest, "id").filter(moved).drop("_before")
        self._publish(snapshot, [log, self._versions(snapshot, rows.withColumn("updated_at", F.current_timestamp())), mark])
        return True

    def delete_sources(self, doomed: DataFrame) -> DataFrame:
        """Delete sources (`id`) and all that hangs on them, in one snapshot; returns the ids that were there."""
        snapshot = self.snapshots.latest()
        present = staged(self.sources(snapshot).join(doomed.select("id").distinct(), "id", "left_semi"), "doomed")
        owners = present.select(F.col("id").alias("source_id"))
        parts = [part for table, schema in _BY_SOURCE.items() for part in self._replaced(snapshot, table, self.spark.createDataFrame([], schema), owners)]
        self._publish(snapshot, [*parts, self._versions(snapshot, present, deleted=True)])
        return present.select("id")
