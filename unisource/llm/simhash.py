"""Near copies by 64-bit SimHash fingerprints, compared exactly tile by tile.

Equal fingerprints are one class from the start. A tile holds the classes with the same population counts, one count
for each block of bits. A differing bit moves one count by one, so two tiles whose counts differ by more
than the radius in sum hold no linked pair and never meet; each other pair of tiles meets once. A tile is compared with
its visitors by exclusive-or and bit counts. There are more blocks the more classes there are, and a tile that is still too
large is cut into parts by hash, each of which all its visitors see: where the cuts lie never changes what is compared.

A task turns its links into stars (member and smallest member of a connected group), so near copies in one tile cost
one row each. Stars are joined into components on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unisource.llm.common import fresh, ids_and_texts, join_rows, row_hash
from unisource.llm.jaccard import spread_labels
from unisource.session import staged

BITS = 64
SEED = 42
SLICE = 1 << 15  # shingles whose bits are held at once
TILE = 4096  # classes that a task holds of a tile
CELLS = 1 << 20  # comparisons made at once


def fingerprint(text: str | None, size: int) -> int:
    """Bit k is set if over half of the text's shingles have it in their hash; 0 without words."""
    data = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not data:
        return 0
    joined = b" ".join(data)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    span = min(size, len(data))
    starts, ends = starts[: len(data) - span + 1], ends[span - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SLICE):
        low, high = starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist()
        own = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(low, high)], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, fp (the fingerprint as a signed number) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row": batch["row"], "fp": own.view(np.int64)})

    read = ids_and_texts(docs).withColumn("row", row_hash(docs["text"]))
    return read.mapInPandas(run, f"doc_id {kind}, row long, fp long")


def block_count(classes: int) -> int:
    """Blocks whose counts cut evenly spread fingerprints into tiles that a task can hold."""
    return 4 if classes <= TILE << 12 else 8 if classes <= TILE << 20 else 16


def steps(blocks: int, radius: int) -> np.ndarray:
    """Differences of counts from a tile to those it visits: of two opposite ones only one, and first the tile itself."""
    near = [(0,) * blocks]
    for _ in range(radius):
        near = list({tuple(s + d * (k == at) for k, s in enumerate(step)) for step, at, d in product(near, range(blocks), (-1, 0, 1))})
    return np.array(sorted(s for s in near if s >= (0,) * blocks), np.int64)


def tile_counts(fps: np.ndarray, blocks: int) -> np.ndarray:
    """Population counts of each fingerprint's blocks."""
    width = BITS // blocks
    shifts = np.arange(blocks, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def dealt(classes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """fp, tile, visit: each class at home and in the tiles it visits; visit 0 is home, 1 its own tile, 2 another one."""
    width = BITS // blocks
    places = (width + 1) ** np.arange(blocks, dtype=np.int64)
    offsets = steps(blocks, radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            own = tile_counts(fps.view(np.uint64), blocks)
            yield pd.DataFrame({"fp": fps, "tile": own @ places, "visit": 0})
            for step in offsets:
                there = own + step
                inside = ((there >= 0) & (there <= width)).all(axis=1)
                yield pd.DataFrame({"fp": fps[inside], "tile": there[inside] @ places, "visit": 2 if step.any() else 1})

    return classes.select("fp").mapInPandas(run, "fp long, tile long, visit int")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every member of a connected group but the smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def close(home: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within the radius, as stars."""
    step = max(1, CELLS // max(1, len(other)))
    pairs = []
    for at in range(0, len(home), step):
        own = home[at : at + step]
        apart = np.bitwise_count((own[:, None] ^ other[None, :]).view(np.uint64))
        i, j = np.nonzero((apart <= radius) & (apart > 0))
        if len(i):
            pairs.append(stars(own[i], other[j]))
    if not pairs:
        return home[:0], home[:0]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return stars(a, b)


def tile_links(classes: DataFrame, blocks: int, radius: int, tile_size: int) -> DataFrame:
    """a, b: classes connected by links that one tile and its visitors show."""
    rows = dealt(classes, blocks, radius)
    sizes = rows.where("visit = 0").groupBy("tile").count().where(F.col("count") > tile_size)
    parts = sizes.select("tile", F.ceil(F.col("count") / tile_size).cast("int").alias("parts"))
    met = rows.join(parts, "tile", "left").where("visit <> 1 or parts is not null").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("visit") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1)
    )
    placed = met.select("tile", F.explode(part).alias("part"), (F.col("visit") > 0).alias("visit"), "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, home = None, np.zeros(0, np.int64)
        for batch in batches:
            tile, part, visit, fp = (batch[c].to_numpy() for c in ("tile", "part", "visit", "fp"))
            change = np.flatnonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1]) | (visit[1:] != visit[:-1])) + 1
            found = []
            for start, end in zip([0, *change], [*change, len(batch)]):
                if start == end:
                    continue
                if key != (tile[start], part[start]):
                    key, home = (tile[start], part[start]), home[:0]
                if not visit[start]:
                    home = np.concatenate([home, fp[start:end]])
                found.append(close(home, fp[start:end], radius))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"a": a, "b": b})

    ordered = placed.repartition("tile", "part").sortWithinPartitions("tile", "part", "visit", "fp")
    return ordered.mapInPandas(run, "a long, b long")


def near_copies(docs: DataFrame, size: int = 3, radius: int = 2, blocks: int | None = None, tile_size: int = TILE) -> DataFrame:
    """doc_id, row, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of each row.

    Fingerprints of `size`-word shingles, repeats included, link at `radius` or fewer differing bits. A text
    shorter than that is one shingle; one without words, null or empty, has fingerprint 0, which links like any other. Repeated
    rows belong to one component; a null doc_id is no component's smallest unless all are null. An empty table gives no rows.
    """
    base = staged(fingerprints(docs, size), "fingerprints")
    classes = staged(base.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "classes")
    blocks = blocks or block_count(classes.count())
    labels = spread_labels(staged(tile_links(classes, blocks, radius, tile_size), "links"))
    owned = classes.join(labels.withColumnRenamed("cid", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = owned.groupBy("label").agg(F.min("smallest").alias("component_id"))
    by_class = owned.join(lowest, "label").select("fp", "component_id")
    return base.join(by_class, "fp").select(
        "doc_id", "row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_first(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; columns as they were."""
    names = docs.columns
    (row,) = fresh(docs, "row")
    kept = near_copies(docs, size, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keyed = docs.withColumn(row, row_hash(docs["text"]))
    first = kept.groupBy("doc_id").agg(F.min("row").alias(row))
    return join_rows(keyed, first, "inner", ("doc_id", row)).dropDuplicates(["doc_id", row]).select(*names)
