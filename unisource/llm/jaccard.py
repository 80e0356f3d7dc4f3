"""Exact Jaccard join of word n-gram sets in metric space.

Jaccard distance is a metric, and so is the symmetric difference of two sets, of which a 4096-bit parity sketch
gives a lower bound. The join narrows down in regions:

* The first pivots are single n-grams. In an order by hash, a set's region is that of its first n-gram; a set within
  reach may have its first one later, so each set is replicated into the window of n-grams where a partner's
  first one can lie (the prefix of the set that a partner of the asked similarity must touch).
* Regions are cut into shells by set size, with the sets of the next smaller shell replicated as boundary.
* Inside a region documents are pivots: sets near a pivot go with it. Sets that lie too far apart by the triangle
  inequality of the sketches' distances are never compared; halves around a pivot join recursively.

Equal sets are one class from the start. A first pass checks each class against one pivot only. Regions where that left
pairs unseen come again, for pairs of classes that are not yet connected: first the closest two of every
two components, then all that is still apart. So a large group of near copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unisource.llm.arrays import WordHasher, grams
from unisource.llm.common import fresh, join_rows, release, row_hash
from unisource.session import drop_shuffles, staged

SKETCH_BITS = 4096
BRUTE = 256  # regions up to this size are compared directly
SKETCH_WORDS = SKETCH_BITS // 64
STEPS = ("stars", "closest", "all")


def gram_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; a shorter text is one n-gram as a whole; none without words."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(size, len(hashes))))


def sketch(members: np.ndarray) -> bytes:
    """Parity of the members that fall on each bit."""
    bits = np.bincount((members % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def shell_edges(num: int, den: int, largest: int) -> np.ndarray:
    """Set sizes at which shells begin: a partner's size lies in the same shell or a neighbouring one."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * den // num + 1)
    return np.array(edges, np.int64)


def described(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, row, n, cid (class of equal sets), shell, prefix, sketch of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(lower=True)
        edges = shell_edges(num, den, 1 << 40)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = gram_set(hasher(text), size)
                n = len(own)
                window = n - -(-num * n // den) + 1 if n else 0
                rows.append((
                    n, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), int(np.searchsorted(edges, n, "right")),
                    own[:window].view(np.int64), sketch(own),
                ))
            yield pd.concat([
                batch[["doc_id", "row"]].reset_index(drop=True),
                pd.DataFrame(rows, columns=["n", "cid", "shell", "prefix", "sketch"]),
            ], axis=1)

    return docs.mapInPandas(run, f"doc_id {kind}, row long, n long, cid long, shell int, prefix array<long>, sketch binary")


def reach(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of these sizes."""
    return (den - num) * (n + m) // (den + num)


def near(sketches: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs that size and sketch do not rule out."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=-1)
    return (den * small >= num * large) & (apart <= reach(n[i], n[j], num, den))


def leaders(members: np.ndarray, sketches: np.ndarray, n: np.ndarray, home: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pivots at home one after another, each with the remaining members near it.

    Boundary sets are no pivots: they meet each other in their own shell, and one must not use up another here.
    """
    left = np.concatenate([members[home[members]], members[~home[members]]])
    while len(left) > 1 and home[left[0]]:
        pivot, rest = left[0], left[1:]
        hit = near(sketches, n, np.full(len(rest), pivot), rest, num, den)
        if hit.any():
            yield np.full(int(hit.sum()), pivot), rest[hit]
        left = rest[~hit]


def joined(members: np.ndarray, sketches: np.ndarray, n: np.ndarray, label: np.ndarray, num: int, den: int, home: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs of members with different labels, one of them at home at least; without `home` all are.

    A pivot halves the members by their distance from it. Partners on both sides of the cut are at most
    the reach away from it; if that leaves most members out, the halves join by themselves and the
    two sides of the cut with each other; else all are compared.
    """
    if home is None:
        home = np.ones(len(label), bool)
    if len(members) < 2 or (label[members] == label[members[0]]).all() or not home[members].any():
        return
    if len(members) > BRUTE:
        far = np.bitwise_count(sketches[members] ^ sketches[members[0]]).sum(axis=1)
        most = int(n[members].max())
        width, cut = int(reach(most, most, num, den)), int(np.median(far))
        inner, outer = members[far <= cut], members[far > cut]
        a, b = members[(far <= cut) & (far > cut - width - 1)], members[(far > cut) & (far <= cut + width)]
        if len(inner) < len(members) and len(a) * len(b) < len(members) ** 2 // 16:
            yield from joined(inner, sketches, n, label, num, den, home)
            yield from joined(outer, sketches, n, label, num, den, home)
            yield from crossed(a, b, sketches, n, label, num, den, home)
            return
    for k in range(len(members) - 1):
        yield from crossed(members[k : k + 1], members[k + 1 :], sketches, n, label, num, den, home)


def crossed(a: np.ndarray, b: np.ndarray, sketches: np.ndarray, n: np.ndarray, label: np.ndarray, num: int, den: int, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in a:
        other = b[(label[b] != label[i]) & (home[b] | home[i])]
        if len(other):
            hit = other[near(sketches, n, np.full(len(other), i), other, num, den)]
            if len(hit):
                yield np.full(len(hit), i), hit


def closest(i: np.ndarray, j: np.ndarray, sketches: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the closest pair of every two labels."""
    apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1)
    low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    order = np.lexsort((apart, high, low))
    return order[np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))]


def candidates(regions: DataFrame, num: int, den: int, step: str) -> DataFrame:
    """a, b: classes of one region to compare; gram, cell, again: whether its region has pairs that were passed over.

    `regions`: gram, cell, cid, n, home, sketch, label. The step is one of STEPS.
    """
    schema = "a long, b long, gram long, cell int, again boolean"

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole regions, one after another in `rows`; those of two members are compared all at once."""
        cid, home, label = rows["cid"].to_numpy(), rows["home"].to_numpy(bool), rows["label"].to_numpy()
        n = rows["n"].to_numpy(np.int64)
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(-1, SKETCH_WORDS)
        starts = np.append(0, region_starts(rows))
        ends = np.append(starts[1:], len(rows))
        two = starts[(ends - starts == 2)]
        two = two[(label[two] != label[two + 1]) & (home[two] | home[two + 1])]
        hit = near(sketches, n, two, two + 1, num, den)
        pairs = [(two[hit], two[hit] + 1)]
        again = np.zeros(len(rows), bool)
        for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            members = np.arange(start, end)
            if step == "stars":
                own = list(leaders(members, sketches, n, home, num, den))
                again[start:end] = bool(own)
            else:
                own = list(met(members, sketches, n, label, home))
                if step == "closest" and own:
                    i, j = (np.concatenate(x) for x in zip(*own))
                    keep = closest(i, j, sketches, label)
                    again[start:end] = True
                    own = [(i[keep], j[keep])]
            pairs += own
        i, j = (np.concatenate(x) for x in zip(*pairs))
        yield pd.DataFrame({
            "a": np.minimum(cid[i], cid[j]), "b": np.maximum(cid[i], cid[j]), "gram": rows["gram"].to_numpy()[i],
            "cell": rows["cell"].to_numpy()[i], "again": again[i],
        })

    def met(members: np.ndarray, sketches: np.ndarray, n: np.ndarray, label: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in joined(members, sketches, n, label, num, den, home):
            keep = closest(i, j, sketches, label) if step == "closest" else slice(None)
            yield i[keep], j[keep]

    def region_starts(rows: pd.DataFrame) -> np.ndarray:
        gram, cell = rows["gram"].to_numpy(), rows["cell"].to_numpy()
        return np.flatnonzero((gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and (held[-1][["gram", "cell"]].iloc[-1] != batch[["gram", "cell"]].iloc[0]).any():
                yield from compared(pd.concat(held))
                held = []
            starts = region_starts(batch)
            if len(starts):
                yield from compared(pd.concat([*held, batch.iloc[: starts[-1]]]))
                held = []
            held.append(batch.iloc[starts[-1] :] if len(starts) else batch)
        if held:
            yield from compared(pd.concat(held))

    rows = regions.repartition("gram", "cell").sortWithinPartitions("gram", "cell", "n", "cid")
    return rows.mapInPandas(run, schema)


def links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar enough, compared member by member."""
    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("a_members"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("b_members"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a_members"], batch["b_members"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_members", "b_members").mapInPandas(run, "a long, b long")


def spread_labels(edges: DataFrame) -> DataFrame:
    """cid, label: the smallest class each class is connected to.

    Each round takes the smallest label among a class and its neighbours and then the label of the label,
    and writes it, so that the plan stays short. Edges both ways are counted by class, which combines before the exchange.
    """
    both = staged(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        least = labels.join(told, "cid").select("cid", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("cid").alias("new"), F.col("label").alias("jumped"))
        moved = staged(least.join(jump, "new").select("cid", F.least("new", "jumped").alias("label"), "old"), "labels")
        labels = moved.select("cid", "label")
        if moved.where("label <> old").isEmpty():
            break
    return labels


def components(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, row, n_shingles, component_id (smallest doc_id reachable by links) of each row.

    Texts link if den * |intersection| >= num * |union| of their sets of `size`-word n-grams. Texts
    without words, null or empty, link with nothing; repeated rows belong to the same component; a null doc_id is
    no component's smallest unless it is alone. An empty table gives no rows.
    """
    read = docs.select("doc_id", "text", row_hash(docs["text"]).alias("row"))
    base = staged(described(read, size, num, den), "sets")
    classes = staged(
        base.where("n > 0").groupBy("cid").agg(
            F.min("doc_id").alias("smallest"), F.first("n").alias("n"), F.first("shell").alias("shell"),
            F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "row")).alias("at"),
        ), "classes",
    )
    # what the result needs of each row, without prefixes and sketches
    rows = staged(base.select("doc_id", "row", "n", "cid"), "rows")
    release(base)
    spread = classes.select("cid", "n", "shell", F.explode("prefix").alias("gram"))
    often = spread.groupBy("gram").count().where("count > 1").select("gram")
    spread = staged(spread.join(often, "gram"), "regions")
    cells = spread.select(
        "gram", "cid", "n", F.explode(F.array(F.struct(F.col("shell").alias("cell"), F.lit(True).alias("home")), F.struct((F.col("shell") + 1).alias("cell"), F.lit(False).alias("home")))).alias("c")
    ).select("gram", "c.cell", "c.home", "cid", "n")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            found = [gram_set(hasher(t), size) for t in batch["text"]]
            yield pd.DataFrame({"cid": batch["cid"], "members": [x.tobytes() for x in found]})

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of classes that are compared, built again from one row of each."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        one_row = classes.join(asked, "cid").select("cid", "at.*")
        texts = join_rows(read, one_row).select("cid", "text").dropDuplicates(["cid"])
        return staged(texts.mapInPandas(members, "cid long, members binary"), "members")

    drawn = classes.select("cid", "sketch")

    # near copies share most of their n-grams: regions with the same sets, told by two hashes of them, count once
    alive = cells.groupBy("gram", "cell").agg(
        F.count(F.lit(1)).alias("k"), F.max("home").alias("any_home"),
        F.bit_xor(F.xxhash64("cid", "home")).alias("x"), F.bit_xor(F.xxhash64("home", "cid", F.lit(1))).alias("y"),
    ).where("k > 1 and any_home").groupBy("cell", "k", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "cell")
    cells = staged(cells.join(alive, ["gram", "cell"]), "cells")
    release(spread)
    found = labels = again = None
    done = [cells]
    for step in STEPS:
        if labels is None:
            told = cells.withColumn("label", F.col("cid"))
        else:
            told = cells.join(again, ["gram", "cell"]).join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            apart = told.groupBy("gram", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
            told = told.join(apart.select("gram", "cell"), ["gram", "cell"])
        met = staged(candidates(told.join(drawn, "cid"), num, den, step), "met")
        pairs = staged(met.select("a", "b").distinct(), "pairs")
        drop_shuffles(docs.sparkSession)
        sets = sets_of(pairs)
        drop_shuffles(docs.sparkSession)
        more = staged(links(pairs, sets, num, den), "links")
        release(sets, pairs)
        done += [met, more]
        again = met.where("again").select("gram", "cell").distinct()
        if labels is None or not more.isEmpty():
            found = more if found is None else found.unionAll(more)
            labels = spread_labels(found)
    release(*done)

    owned = classes.select("cid", "smallest").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = owned.groupBy("label").agg(F.min("smallest").alias("component_id"))
    by_class = owned.join(lowest, "label").select("cid", "component_id")
    told = rows.join(by_class, "cid", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    told = staged(told, "components")
    release(classes, rows, labels)
    return told


def keep_first(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; columns as they were."""
    names = docs.columns
    row, at = fresh(docs, "row", "at")
    found = components(docs, size, num, den).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.struct("doc_id", "row").alias(at)).distinct()
    # one key column, equal to itself where the id is null: rows with their texts are dealt out once, for the join and for the repeats
    key = F.struct("doc_id", F.col(row).alias("row")).cast(kept.schema[at].dataType)
    keyed = docs.withColumn(row, row_hash(docs["text"])).withColumn(at, key)
    return keyed.join(kept, at, "left_semi").dropDuplicates([at]).select(*names)
