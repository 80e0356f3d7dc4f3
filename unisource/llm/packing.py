"""Packing token sequences as a cutting-stock problem solved by column generation.

Documents are tokenized where they lie and cut into pieces of at most one sequence. What the driver gets is
the histogram of piece lengths in steps of 8 tokens, at most 128 counters. A linear program over patterns
(which length classes share a sequence) is solved by column generation: knapsack dynamic programming
prices new patterns against the dual values until none improves. Its solution is rounded down, the
few pieces left over are placed first-fit, and every piece finds its pattern by its rank in its length class.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unisource.session import staged

SEQUENCE = 1024
STEP = 8
END_ID = 0
#: Stretches a task keeps between batches, and ids for each on average; longer ones are not kept.
CACHE_WORDS = 900_000
CACHE_TOKENS = 8
CACHE_CHARS = 64
JOINED_WORDS = 200
#: White space of ASCII, but for single spaces and line ends.
ODD_SPACES = ["  ", " \n", "\n ", "\n\n", *map(chr, [9, 11, 12, 13, 28, 29, 30, 31])]


class CachedEncoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer's own splitting never joins what a single space or line end separates from what stands
    before it, so such stretches are encoded once and looked up afterwards: each has a number, and their ids lie one after
    another in one array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a token's name has one character for each of its bytes
        names = {i: name for name, i in self.library.get_vocab().items()}
        self.n_bytes = np.array([len(names.get(i, "")) for i in range(max(names) + 1)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.cache: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, "<u4")
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches, where those of each begin and how many they are. Many are encoded in one text: their ends
        are found again by the bytes of the tokens.

        The first word of a text gets a line end before it, which is a token of its own.
        """
        ids, begins, sizes, before = [], [], [], 0
        for start in range(0, len(words), JOINED_WORDS):
            own = words[start : start + JOINED_WORDS]
            first = np.array([w[0] == " " for w in own])
            joined = [w if w[0] == "\n" else "\n" + w[1:] if w[0] == " " else " " + w for w in own]
            text = "".join(joined)
            found = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            until = np.cumsum(self.n_bytes[found])
            ends = np.cumsum(list(map(len, joined if text.isascii() else map(str.encode, joined))))
            at = np.searchsorted(until, ends)
            if at[-1] >= len(until) or (until[at] != ends).any():
                # a token across two stretches: not with byte-level vocabularies
                apart = [np.frombuffer(x, "<u4") for x in self.whole([w[1:] if f else w for w, f in zip(joined, first)])]
                found, first = np.concatenate(apart), 0
                at = np.cumsum([len(x) for x in apart]) - 1
            begin = np.append(0, at[:-1] + 1) + first
            ids.append(found)
            begins.append(before + begin)
            sizes.append(at + 1 - begin)
            before += len(found)
        return np.concatenate(ids), np.concatenate(begins), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, number = len(self.cache), self.cache.__getitem__
        # looked up while a text's words are still near the core
        numbers = [np.array(list(map(number, self.stretches(t))), np.int64) for t in texts]
        # numbers are dealt in the order of the dictionary, so the new words are its last
        new = list(islice(reversed(self.cache), len(self.cache) - known))[::-1]
        if new:
            ids, begins, sizes = self.alone(new)
            self.begins = np.append(self.begins, begins + len(self.ids))
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, ids)
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        sizes = self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        packed = self.ids[np.repeat(self.begins[at] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.append(0, np.cumsum([len(x) for x in numbers], dtype=np.int64))]).tolist()
        rest = iter(self.whole([t for t, x in zip(texts, numbers) if not len(x)]))
        found = [packed[a:b] if len(x) else next(rest) for x, a, b in zip(numbers, cuts, cuts[1:])]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
        if max(len(self.cache), len(self.ids) // CACHE_TOKENS) > CACHE_WORDS:
            self.forget()
        return found

    def single_spaced(self, text: str) -> bool:
        """No other white space than single spaces and line ends inside the text."""
        if not text.isascii():
            return text.replace("\n", " ") == " ".join(text.split())
        return text[0] not in " \n" and text[-1] not in " \n" and not any(map(text.__contains__, ODD_SPACES))

    def stretches(self, text: str) -> list[str]:
        """A text's words, those at the begin of a line with the line end, that of the text with a space before them.

        Nothing if the text must be encoded as a whole: for a special string or other white space.
        """
        if not text or not self.single_spaced(text) or any(map(text.__contains__, self.special)):
            return []
        words = text.replace("\n", " \n").split(" ")
        words[0] = " " + words[0]
        return words


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def cut(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and task, class and place in it.

    A document is cut into full sequences and a rest. Its ids are the tokenizer's and a final 0, so an
    empty or null text is one piece of one id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, class int, place long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size // STEP + 2, np.int64)
        end_id = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            begin = chars = 0
            for end, text in enumerate(texts, 1):
                chars += len(text)
                if chars < 2_000_000 and end < len(texts):
                    continue
                ids = [x + end_id for x in own.encode(texts[begin:end])]
                totals = np.array([len(x) // 4 for x in ids], np.int64)
                counts = -(-totals // size)
                of = np.repeat(np.arange(len(ids)), counts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
                length = np.minimum(totals[of] - start, size)
                crc = [zlib.crc32(x[k : k + 4 * size]) for x in ids for k in range(0, len(x), 4 * size)]
                classes = -(-length // STEP)
                # pieces of a class are numbered on from those this task has seen
                order = np.argsort(classes, kind="stable")
                found, first, n = np.unique(classes[order], return_index=True, return_counts=True)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(first, n) + np.repeat(seen[found], n)
                seen[found] += n
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[begin:end].iloc[of].array, "start": start, "length": length, "ids_crc32": crc,
                    "doc_tokens": totals[of], "task": task, "class": classes, "place": place,
                })
                begin, chars = end, 0

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of highest value that fits: unbounded knapsack by dynamic programming."""
    useful = np.flatnonzero(values > 0)
    small, worth = sizes[useful], values[useful]
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    fits = np.searchsorted(small, np.arange(room + 1), "right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if fits[r]:
            options = best[r - small[: fits[r]]] + worth[: fits[r]]
            k = int(options.argmax())
            if options[k] > best[r]:
                best[r], take[r] = options[k], useful[k]
    pattern = np.zeros(len(sizes), np.int64)
    r = room
    while r > 0:
        if take[r] < 0:
            r -= 1
        else:
            pattern[take[r]] += 1
            r -= sizes[take[r]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 2000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program's solution.

    The basis starts with patterns of one class each; each round prices one new pattern with the dual
    values and exchanges it for the column that runs out first. A best price of 1 + gap proves the solution to
    be within `gap` of the optimum, so that is where it stops.
    """
    basis = np.diag(room // sizes).astype(float)
    used = demand / (room // sizes)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = best_pattern(duals, sizes, room)
        if value <= 1 + gap:
            break
        along = np.linalg.solve(basis, pattern)
        can = along > 1e-7
        if not can.any():
            break
        steps = np.where(can, used / np.where(can, along, 1), np.inf)
        basis[:, int(np.argmin(steps))] = pattern
        used = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis.astype(np.int64), used


def first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for a few pieces, largest first."""
    open_: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[k])):
            for i, (free, pattern) in enumerate(open_):
                if sizes[k] <= free:
                    pattern[k] += 1
                    open_[i] = (free - int(sizes[k]), pattern)
                    break
            else:
                pattern = np.zeros(len(sizes), np.int64)
                pattern[k] = 1
                open_.append((room - int(sizes[k]), pattern))
    return [p for _, p in open_]


@dataclass(frozen=True)
class Plan:
    """For each class the ranks at which a pattern begins, with what it takes to place a piece."""

    starts: dict[int, np.ndarray]
    per: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    sequences: int

    def place(self, c: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot in it of pieces of one class."""
        k = np.searchsorted(self.starts[c], rank, "right") - 1
        inside = rank - self.starts[c][k]
        return self.first[c][k] + inside // self.per[c][k], inside % self.per[c][k]


def plan_sequences(histogram: dict[int, int], room: int = SEQUENCE // STEP) -> Plan:
    """Patterns for a histogram of classes; every piece gets exactly one place."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    demand = np.array([histogram[c] for c in sizes.tolist()], np.int64)
    if not len(sizes):
        return Plan({}, {}, {}, 0)
    basis, used = column_generation(sizes, demand.astype(float), room)
    times = np.floor(used + 1e-6).astype(np.int64)
    left = demand - basis @ times
    while (left < 0).any():  # rounding errors of the solution: use a pattern less often
        k = int(np.argmin(left))
        j = int(np.argmax(np.where(basis[k] > 0, times, -1)))
        times[j] -= min(int(times[j]), int(-(left[k] // basis[k, j])))
        left = demand - basis @ times
    patterns = [(basis[:, k], int(t)) for k, t in enumerate(times) if t > 0]
    patterns += [(p, 1) for p in first_fit(sizes, left, room)]
    rows: dict[int, list[tuple[int, int, int]]] = {int(c): [] for c in sizes}
    taken, sequence = dict.fromkeys(rows, 0), 0
    for pattern, times_ in patterns:
        for k in np.flatnonzero(pattern):
            c, a = int(sizes[k]), int(pattern[k])
            rows[c].append((taken[c], a, sequence))
            taken[c] += a * times_
        sequence += times_
    split = {c: np.array(r, np.int64) for c, r in rows.items()}
    return Plan({c: r[:, 0] for c, r in split.items()}, {c: r[:, 1] for c, r in split.items()}, {c: r[:, 2] for c, r in split.items()}, sequence)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ranks within a class come from counts by task, so that a class with most of the pieces never meets in one
    task. Repeated rows are packed each; an empty table gives no rows.
    """
    pieces = staged(cut(docs, tokenizer), "pieces")
    by_task = pieces.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("class").agg(F.sum("n")).collect()}
    plan = plan_sequences(histogram)
    before = by_task.select(
        "task", "class",
        (F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).alias("before"),
    )
    ranked = pieces.join(before, ["task", "class"]).withColumn("rank", F.col("place") + F.col("before"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, slot = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            classes, rank = batch["class"].to_numpy(), batch["rank"].to_numpy()
            for c in np.unique(classes):
                own = classes == c
                sequence[own], slot[own] = plan.place(int(c), rank[own])
            yield batch.assign(sequence_id=sequence, slot=slot)[names]

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
    names = [*kept, "sequence_id", "slot"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*kept).schema) + ", sequence_id long, slot long"
    found = ranked.select(*kept, "rank").mapInPandas(placed, schema)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(order) - F.col("length")).alias("offset"),
    )
