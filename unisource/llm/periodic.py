"""Maximal periodic runs of words, found octave by octave in overlapping tiles.

The periods of octave k lie from 2^k to 2^(k+1) - 1. A run repeats its period four times at least, so it holds at least three
places that are multiples of 2^k; these are the octave's boundaries. Forward and backward Z-functions at a boundary
say for each period of the octave at once how far the words around it agree with those one period later. So:

* A document is exploded into tiles of each octave: stretches around the boundaries where the words at the
  boundary come again within the octave's periods. Tiles overlap as far as a boundary's Z-functions reach.
* Every tile is solved by itself, by any task, and gives fragments: stretches of places whose word comes again one period later.
* Fragments are shuffled by document and period, and those that touch are stitched.

A period that is a multiple of a shorter one is told by the forward Z-function at the boundary and left out there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from unisource.llm.arrays import MIX, mixed
from unisource.llm.common import ids_and_texts, join_rows, row_hash
from unisource.session import staged

TIMES = 4  # a run is as many periods long, at least
LEAST = 6  # and as many words
TILE_WORDS = 4096  # boundaries next to each other share a tile up to about this length
YIELD_BYTES = 1 << 23
GRAM = 16  # words compared to tell which boundaries can lie in a run
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def codes_of(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def gram_codes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, 8 and 16 words from each place on; equal words have equal hashes."""
    out = {1: mixed(codes.astype(np.uint64) + np.uint64(1))}
    while (size := max(out)) < GRAM and len(codes) >= 2 * size:
        out[2 * size] = mixed(out[size][:-size] * MIX + out[size][size:])
    return out


def active_boundaries(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Octave and those of its boundaries that can lie in a run.

    Of a run's places, three periods come again one period later. So beyond two boundaries next to each other at least the
    words of a boundary's reach, 2^k, come again, and beyond one of them twice as many.
    """
    n = len(codes)
    if n < LEAST:
        return
    grams = gram_codes(codes)
    recurs = Recurrences(grams[max(grams)])
    k = 0
    while TIMES << k <= n:
        size, double = min(1 << k, GRAM), min(max(2 << k, 4), GRAM)
        boundaries = np.arange(0, n - size + 1, 1 << k)
        if size < GRAM:
            found = recurring(grams[size], boundaries, 1 << k)
            sure = found.any() and recurring(grams[double], boundaries[boundaries <= n - double], 1 << k)
        else:
            found = sure = recurs.within(boundaries, 1 << k, 2 << k)
        if np.any(sure):
            # stretches of boundaries next to each other, two at least and one of them sure
            edge = np.flatnonzero(np.diff(found, prepend=False, append=False))
            seen = np.append(0, np.cumsum(sure))
            for start, end in zip(edge[::2], edge[1::2]):
                if end - start > 1 and seen[min(end, len(sure))] > seen[min(start, len(sure))]:
                    yield k, boundaries[start:end]
        k += 1


def recurring(gram: np.ndarray, boundaries: np.ndarray, unit: int) -> np.ndarray:
    """Whether a boundary's words come again at one of the periods unit to 2 * unit - 1."""
    found = np.zeros(len(boundaries), bool)
    for q in range(unit, 2 * unit):
        met = boundaries[: np.searchsorted(boundaries, len(gram) - q)]
        found[: len(met)] |= gram[met] == gram[met + q]
    return found


class Recurrences:
    """Where the same gram comes again, by search in the places sorted by gram."""

    def __init__(self, gram: np.ndarray):
        self.n = len(gram)
        _, self.kind, self.count = np.unique(gram, return_inverse=True, return_counts=True)
        self.by_kind = np.sort(self.kind * self.n + np.arange(self.n))

    def within(self, boundaries: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether a boundary's gram starts again at a distance from low to before high."""
        found = np.zeros(len(boundaries), bool)
        often = np.flatnonzero(self.count[self.kind[boundaries]] > 1)
        at = boundaries[often]
        own = self.kind[at] * self.n
        first, last = (np.searchsorted(self.by_kind, own + np.minimum(at + d, self.n)) for d in (low, high))
        found[often] = last > first
        return found


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """octave, place of the first word, first boundary (from there), boundaries, words as 32-bit numbers."""
    for k, boundaries in active_boundaries(codes):
        unit = 1 << k
        most = max(1, TILE_WORDS // unit)
        for start in range(0, len(boundaries), most):
            first, last = int(boundaries[start]), int(boundaries[start : start + most][-1])
            at = max(0, first - unit)
            yield k, at, first - at, (last - first) // unit + 1, codes[at : last + 4 * unit].tobytes()


def z_function(s: list[int], places: int) -> list[int]:
    """How far the list agrees with itself from each of the first places on."""
    z = [0] * places
    left = right = 0
    n = len(s)
    for i in range(1, places):
        same = min(right - i, z[i - left]) if i < right else 0
        while i + same < n and s[same] == s[i + same]:
            same += 1
        z[i] = same
        if i + same > right:
            left, right = i, i + same
    return z


@lru_cache(1 << 16)
def largest_divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def boundary_fragments(words: list[int], b: int, unit: int) -> Iterator[tuple[int, int, int]]:
    """period, start, end of the places around a boundary whose word comes again one period later."""
    ahead = words[b : b + 4 * unit]
    forward = z_function(ahead, min(2 * unit, len(ahead)))
    periods = [
        q for q in range(unit, len(forward))
        if forward[q] >= unit and not any(forward[d] >= q - d for d in largest_divisors(q))
    ]
    if not periods:
        return
    before = words[max(0, b - unit) : b][::-1]
    far = periods[-1]
    text = words[max(0, b - unit) : b + far][::-1]
    backward = z_function([*before, -1, *text], len(before) + 1 + far - unit + 1)
    for q in periods:
        yield q, b - backward[len(before) + 1 + far - q], b + min(forward[q], 2 * unit)


def solve(k: int, at: int, first: int, boundaries: int, data: bytes) -> Iterator[tuple[int, int, int]]:
    """period, start, end of the fragments of one tile; those of one period that touch are one."""
    words = np.frombuffer(data, np.int32).tolist()
    unit = 1 << k
    last: dict[int, list[int]] = {}
    for b in range(first, first + boundaries * unit, unit):
        for q, start, end in boundary_fragments(words, b, unit):
            known = last.get(q)
            if known and start <= known[1]:
                known[1] = max(end, known[1])
            else:
                if known:
                    yield q, at + known[0], at + known[1]
                last[q] = [start, end]
    for q, (start, end) in last.items():
        yield q, at + start, at + end


def exploded(docs: DataFrame) -> DataFrame:
    """One row per document (k = -1) with the hash of its words, and one per tile.

    A document's words, joined by one space, are kept only where it has a tile.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "row", "n_words", "plain", "text", "k", "at", "first", "boundaries", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for doc, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                before = len(rows)
                for tile in tiles(codes_of(words)):
                    rows.append((doc, row, 0, None, None, *tile))
                    size += len(tile[-1])
                    if size > YIELD_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size, before = [], 0, -1
                joined = b" ".join(words)
                some = len(rows) != before
                rows.append((
                    doc, row, len(words), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if some else None,
                    -1, 0, 0, 0, None,
                ))
                size += len(joined) if some else 0
            yield pd.DataFrame(rows, columns=columns)

    return docs.mapInPandas(
        run, f"doc_id {kind}, row long, n_words long, plain string, text string, k int, at long, first int, boundaries int, data binary"
    )


def fragments(tiles_: DataFrame) -> DataFrame:
    """doc_id, row, period, start, end of the fragments of all tiles."""
    kind = tiles_.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, row, q, start, end)
                for doc, row, *tile in batch[["doc_id", "row", "k", "at", "first", "boundaries", "data"]].itertuples(index=False, name=None)
                for q, start, end in solve(*tile)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "period", "start", "end"])

    spread = tiles_.select("doc_id", "row", "k", "at", "first", "boundaries", "data").hint("rebalance")
    return spread.mapInPandas(run, f"doc_id {kind}, row long, period long, start long, end long")


def stitched(found: DataFrame) -> DataFrame:
    """doc_id, row, start, length, period of each run, from fragments that touch or overlap."""
    before = Window.partitionBy("doc_id", "row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = found.dropDuplicates().withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    numbered = islands.withColumn("island", F.sum("new").over(upto))
    runs = numbered.groupBy("doc_id", "row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return runs.select("doc_id", "row", "start", length.alias("length"), "period").where(
        (F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))
    )


@F.pandas_udf(StringType())
def without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The words of a text, joined by one space, but for those from a start to before its end."""

    def one(t, a, b):
        if not isinstance(t, str) or a is None:
            return None
        words = t.split(" ")
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, np.asarray(a, np.int64), 1)
        np.add.at(depth, np.asarray(b, np.int64), -1)
        return " ".join(w for w, d in zip(words, np.cumsum(depth)) if not d)

    return pd.Series([one(*x) for x in zip(text, starts, ends)], dtype=object)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed, collapsed_sha256 of each row.

    `runs`: start, period, length of each maximal run of four periods and six words at least, by start and period.
    `collapsed`: the words without a run's repeats, joined by one space; null where a text has no run and all
    its words stay. `collapsed_sha256` is there for every row: for a null or empty text that of no characters. Rows
    that repeat get the same result each, rows with one id and different texts their own; a null doc_id is an id like others;
    an empty table gives no rows.
    """
    read = ids_and_texts(docs).withColumn("row", row_hash(docs["text"]))
    tiled = staged(exploded(read), "tiles")
    runs = stitched(fragments(tiled.where("k >= 0"))).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    )
    rows = tiled.where("k = -1").select("doc_id", "row", "n_words", "plain", "text")
    met = join_rows(rows.where("text is not null"), runs, "left")
    starts = F.transform("runs", lambda r: r["start"] + r["period"])
    ends = F.transform("runs", lambda r: r["start"] + r["length"])
    collapsed = met.withColumn("collapsed", without("text", starts, ends))
    rest = rows.where("text is null").withColumn("runs", F.lit(None).cast(RUNS)).withColumn("collapsed", F.lit(None).cast("string"))
    columns = [
        "doc_id", "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed", F.coalesce(F.sha2("collapsed", 256), "plain").alias("collapsed_sha256"),
    ]
    return collapsed.select(*columns).unionAll(rest.select(*columns))
