"""Removal of repeated word sequences with an FM-index per shard.

Every window of 35 words has a minimizer, the smallest hash among its runs of 8 words; equal windows have equal
minimizers. Windows that follow each other with the same minimizer form a segment. Segments whose minimizer occurs
once in the corpus repeat nothing and go no further. Equal segments are counted before anything else: all
their windows repeat. What remains, different segments with one minimizer, is put into shards by minimizer; each
shard builds an index of its segments and streams them through it as queries. A minimizer with very many
different segments is not one shard: its windows are counted by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unisource.llm.arrays import MIX, WordHasher, grams, mixed
from unisource.llm.common import join_rows, row_hash
from unisource.llm.fmindex import FMIndex
from unisource.session import staged

WINDOW = 35
GRAM = 8
RUN = WINDOW - GRAM + 1  # at most so many windows share one place of a minimizer, so a mask has 28 bits
SHARD_WORDS = 300_000  # words of one index
#: Different segments of one minimizer that an index takes; beyond that its windows are counted by hash.
MAX_SEGMENTS = 2_000


def segment_bounds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each segment of a text."""
    if len(hashes) < WINDOW:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    runs = grams(hashes, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(runs, RUN)
    place = np.arange(len(view)) + view.argmin(axis=1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return runs[place[first]], first, np.diff(np.append(first, len(view)))


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words, whatever its length."""
    powers = np.empty(len(hashes) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = MIX
    powers = np.multiply.accumulate(powers)
    total = np.append(np.uint64(0), np.cumsum(mixed(hashes) * powers[1:][::-1]))
    # the same words have the same sum but for a power of an odd number, which an inverse takes away
    inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
    back = np.empty(len(hashes) + 1, np.uint64)
    back[0] = 1
    back[1:] = inverse
    back = np.multiply.accumulate(back)
    ends = starts + lengths
    return mixed((total[ends] - total[starts]) * back[len(hashes) - ends] + lengths.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, row, key (minimizer), segment (hash of its words), start, n (windows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(lower=False)
        for batch in batches:
            found = []
            for k, text in enumerate(batch["text"]):
                words = hasher(text)
                key, start, n = segment_bounds(words)
                if len(key):
                    found.append((np.full(len(key), k), signed(key), signed(sequence_hashes(words, start, n + WINDOW - 1)), start, n))
            if found:
                of, key, segment, start, n = map(np.concatenate, zip(*found))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[of].array, "row": batch["row"].iloc[of].array, "key": key, "segment": segment,
                    "start": start, "n": n,
                })

    return docs.mapInPandas(run, f"doc_id {kind}, row long, key long, segment long, start int, n int")


def with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words' hashes, packed, of wanted (key, segment, n, doc_id, row, start)."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "segment", "start", "n")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(lower=False)
        for batch in batches:
            rows = []
            for text, wanted_ in zip(batch["text"], batch["wanted"]):
                words = hasher(text)
                rows += [(w["key"], w["segment"], w["n"], words[w["start"] : w["start"] + w["n"] + WINDOW - 1].tobytes()) for w in wanted_]
            yield pd.DataFrame(rows, columns=["key", "segment", "n", "words"])

    met = join_rows(docs, lists).select("text", "wanted")
    return met.mapInPandas(run, "key long, segment long, n int, words binary").dropDuplicates(["key", "segment"])


def shard_masks(rows: pd.DataFrame) -> pd.DataFrame:
    """One index over some segments: which of their windows occur at least twice in it."""
    words = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    lengths = np.array([len(w) for w in words])
    distinct, symbols = np.unique(np.concatenate(words), return_inverse=True)
    # segments one after another, each closed by the symbol 0
    text = np.zeros(int(lengths.sum()) + len(words), np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    inside = np.ones(len(text), bool)
    inside[begins + lengths] = False
    text[inside] = symbols + 1
    n = rows["n"].to_numpy()
    owner = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    again = FMIndex(text, WINDOW).occurs_again(text, begins[owner] + offset, WINDOW)
    mask = np.zeros(len(rows), np.int64)
    np.bitwise_or.at(mask, owner[again], np.int64(1) << offset[again])
    return pd.DataFrame({"key": rows["key"].to_numpy(), "segment": rows["segment"].to_numpy(), "mask": mask})


def index_masks(worded: DataFrame) -> DataFrame:
    """key, segment, mask by indexes over whole minimizers, as many of them as fit one index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.add.reduceat(np.fromiter(map(len, batch["words"]), np.int64, len(batch)) // 8, starts)
            begin = 0
            for start, own in zip(starts.tolist(), sizes.tolist()):
                same = start == 0 and held and held[-1]["key"].iloc[-1] == key[0]
                if size >= SHARD_WORDS and not same:
                    yield shard_masks(pd.concat([*held, batch.iloc[begin:start]]))
                    held, size, begin = [], 0, start
                size += own
            held.append(batch.iloc[begin:])
        if held:
            yield shard_masks(pd.concat(held))

    return worded.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key long, segment long, mask long")


def window_masks(worded: DataFrame) -> DataFrame:
    """key, segment, mask by counting window hashes, for minimizers with too many segments for an index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, segment, n, words in zip(batch["key"], batch["segment"], batch["n"], batch["words"]):
                own = np.frombuffer(words, np.uint64)
                starts = np.arange(n)
                yield pd.DataFrame({
                    "key": key, "segment": segment, "bit": starts, "window": signed(sequence_hashes(own, starts, np.full(n, WINDOW))),
                    "more": signed(mixed(own[starts] * MIX + own[starts + WINDOW - 1])),
                })

    windows = worded.mapInPandas(run, "key long, segment long, bit int, window long, more long")
    often = windows.groupBy("window", "more").count().where("count > 1").drop("count")
    return windows.join(often, ["window", "more"]).groupBy("key", "segment").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, mask: bit k says that the window from word start + k occurs elsewhere."""
    found = staged(segments(docs), "segments")
    often = found.groupBy("key").count().where("count > 1").select("key")
    shared = staged(found.join(often, "key"), "shared")
    distinct = shared.groupBy("key", "segment").agg(
        F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("at")
    )
    kinds = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed_ = distinct.join(kinds, "key").select("key", "segment", "n", "copies", "kinds", "at.*")
    worded = staged(with_words(docs, mixed_.select("key", "segment", "n", "doc_id", "row", "start")), "words")
    hot = kinds.where(F.col("kinds") > MAX_SEGMENTS).select("key")
    searched = index_masks(worded.join(hot, "key", "left_anti")).unionAll(window_masks(worded.join(hot, "key", "left_semi")))
    full = distinct.where("copies > 1").select("key", "segment", (F.expr("shiftleft(1L, n)") - 1).alias("mask"))
    masks = searched.unionAll(full).groupBy("key", "segment").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    return shared.join(masks, ["key", "segment"]).select("doc_id", "row", "start", "mask")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) of each row.

    A text under 35 words, null or empty keeps all it has; a repeated row is a second occurrence of all its
    windows; an empty table gives no rows. Kept words are joined by one space.
    """
    read = docs.select("doc_id", "text", row_hash(docs["text"]).alias("row"))
    marks = repeated_windows(read).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.arange(RUN)
        for batch in batches:
            rows = []
            for doc, text, marks_ in zip(batch["doc_id"], batch["text"], batch["marks"]):
                # bytes know only the white space of ASCII, which is what separates words
                left = words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                if marks_ is not None and len(marks_):
                    gone = np.zeros(len(words) + 1, np.int64)
                    starts = np.concatenate([m["start"] + bits[(m["mask"] >> bits) & 1 == 1] for m in marks_])
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + WINDOW, -1)
                    left = list(compress(words, (np.cumsum(gone)[:-1] == 0).tolist()))
                kept = b" ".join(left)
                rows.append((doc, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return join_rows(read, marks, "left").select("doc_id", "text", "marks").mapInPandas(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    )
