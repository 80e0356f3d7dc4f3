"""Language by words first: known words by their frequency in each language, others by character n-grams.

All words and n-grams stay, as tables that grow with the corpus and are never in one place. Entries are dealt to parts by
hash and travel packed: a batch of training texts sends each part the words it counted, a part adds them up, and its
words' n-grams are counted in the same way. A slice of documents asks each part for the counts of its distinct words, then
for the n-grams of those that no language knows. Such a word is read from left to right: at each place the longest known
n-gram counts, 5 to 1 characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.llm.common import fresh
from unisource.session import staged

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
SLICE_CHARS = 4_000_000
PART_CHARS = 16_000_000  # a part of the tables is for about so many characters of training text
UNKNOWN = "und"


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def gram_counts(words: dict[str, int]) -> dict[str, int]:
    """How often each character n-gram stands in words of these numbers, with the ends of words marked."""
    found: defaultdict[str, int] = defaultdict(int)
    for word, n in words.items():
        marked = f"^{word}$"
        size = len(marked)
        for k in range(size):
            for end in range(k + 1, min(k + LONGEST, size) + 1):
                found[marked[k:end]] += n
    return found


def packed(entries: list[str]) -> bytes:
    """Words or n-grams as bytes; none has a line end."""
    return zlib.compress("\n".join(entries).encode(), 1)


def unpacked(data: bytes) -> list[str]:
    return zlib.decompress(data).decode().split("\n")


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest bytes of all of them first: most others are zero."""
    return zlib.compress(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.tobytes(), "<i8")


def part_of(entries: list[str], parts: int) -> np.ndarray:
    return (pd.util.hash_array(np.array(entries, object), categorize=False) % np.uint64(parts)).astype(np.int64)


def dealt(entries: list[str], parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its entries, in order."""
    if entries:
        part = part_of(entries, parts)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(order, edges):
            yield int(part[own[0]]), own


def dealt_counts(lang: int, found: dict[str, int], parts: int) -> pd.DataFrame:
    entries, n = list(found), np.fromiter(found.values(), np.int64, len(found))
    rows = [(p, lang, packed([entries[k] for k in own]), packed_numbers(n[own])) for p, own in dealt(entries, parts)]
    return pd.DataFrame(rows, columns=["part", "lang", "entries", "n"])


COUNTS = "part int, lang int, entries binary, n binary"


def word_counts(docs: DataFrame, langs: list[str], parts: int) -> DataFrame:
    """Words of the training texts by batch, language and part."""
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                seen: Counter[str] = Counter()
                for text in texts:
                    seen.update(letter_words(text))
                yield dealt_counts(number[lang], seen, parts)

    return docs.mapInPandas(run, COUNTS)


def gram_counts_of(table: DataFrame, parts: int, width: int) -> DataFrame:
    """N-grams of a table's words by part of the words, language and part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for entries, n in zip(batch["entries"], batch["n"]):
                words, numbers = unpacked(entries), unpacked_numbers(n).reshape(width, -1)
                for lang, own in enumerate(numbers):
                    seen = np.flatnonzero(own)
                    yield dealt_counts(lang, gram_counts(dict(zip([words[k] for k in seen], own[seen].tolist()))), parts)

    # the table is small as files, so it would be read by few tasks
    return table.select("part", "entries", "n").repartition(parts, "part").mapInPandas(run, COUNTS)


def summed(counted: DataFrame, width: int, words: bool) -> DataFrame:
    """One row a part: entries, n (their occurrences, language by language), and by size (0 for words) the occurrences in
    each language and the number of entries."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place: defaultdict[str, int] = defaultdict(count().__next__)
        at = [np.fromiter(map(place.__getitem__, unpacked(e)), np.int64) for e in rows["entries"]]
        total = np.zeros((width, len(place)), np.int64)
        for lang, own, n in zip(rows["lang"], at, rows["n"]):
            total[lang, own] += unpacked_numbers(n)  # the entries of a row are distinct
        entries = sorted(place)
        total = total[:, [place[e] for e in entries]]
        size = np.zeros(len(entries), np.int64) if words else np.fromiter(map(len, entries), np.int64)
        totals = np.zeros((LONGEST + 1, width), np.int64)
        np.add.at(totals, size, total.T)
        return pd.DataFrame({
            "part": rows["part"].iloc[:1].to_numpy(), "entries": [packed(entries)], "n": [packed_numbers(total.ravel())],
            "totals": [totals.ravel()], "types": [np.bincount(size, minlength=LONGEST + 1)],
        })

    return counted.groupBy("part").applyInPandas(run, "part int, entries binary, n binary, totals array<long>, types array<long>")


def added(table: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of an array column, place by place."""
    out = np.zeros(size, np.int64)
    for r in table.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, occurrences by size and language, distinct entries by size, and the tables of all counts.

    The tables have part, entries (packed) and n (packed, language by language); `columns` says where in them the languages
    are, as those without a word are left out.
    """

    langs: list[str]
    columns: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    parts: int
    words: DataFrame
    grams: DataFrame


def logs_of(n: np.ndarray, totals: np.ndarray, types: int, size: int) -> np.ndarray:
    """Log frequencies of counts in each language; those of an n-gram weigh by its length."""
    return np.log((n + 0.5) / (totals + 0.5 * (types + 1))) * (size / LONGEST if size else 1.0)


def fit(docs: DataFrame) -> LanguageModel:
    """The model of all rows of `docs` (text, lang). The driver gets the totals only."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    found = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()
    langs = sorted(r["lang"] for r in found)
    width, parts = len(langs), int(max(16, sum(r["chars"] for r in found) // PART_CHARS))
    words = staged(summed(word_counts(rows, langs, parts), width, True), "language-words")
    grams = staged(summed(gram_counts_of(words, parts, width), width, False), "language-grams")
    totals, types = (added(words, c, s) + added(grams, c, s) for c, s in (("totals", (LONGEST + 1) * width), ("types", LONGEST + 1)))
    totals = totals.reshape(LONGEST + 1, width)
    columns = np.flatnonzero(totals[0])
    return LanguageModel([langs[k] for k in columns], columns, totals[:, columns], types, parts, words, grams)


def places(marked: str) -> Iterator[list[str]]:
    """At each place of a word its n-grams, the longest first."""
    size = len(marked)
    for k in range(size):
        yield [marked[k:end] for end in range(min(k + LONGEST, size), k, -1)]


def grams_of(words: list[str]) -> list[str]:
    return sorted({g for w in words for found in places(f"^{w}$") for g in found})


ASKED = "part int, batch long, entries binary"


def asked_of(batch: int, entries: list[str], parts: int) -> pd.DataFrame:
    rows = [(p, batch, packed([entries[k] for k in own])) for p, own in dealt(entries, parts)]
    return pd.DataFrame(rows, columns=["part", "batch", "entries"])


def answers(asked: DataFrame, table: DataFrame, columns: np.ndarray) -> DataFrame:
    """batch, part, n: the counts of what a batch asked a part for, in the order asked."""

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        entries = unpacked(known["entries"].iloc[0]) if len(known) and len(asked) else []
        place = dict(zip(entries, range(len(entries))))
        n = np.zeros((len(columns), len(entries) + 1), np.int64)  # the last one for what no language knows
        if entries:
            n[:, :-1] = unpacked_numbers(known["n"].iloc[0]).reshape(-1, len(entries))[columns]
        rows = []
        for part, batch, own in zip(asked["part"], asked["batch"], asked["entries"]):
            at = np.array([place.get(e, -1) for e in unpacked(own)], np.int64)
            rows.append((batch, part, packed_numbers(n[:, at].ravel())))
        return pd.DataFrame(rows, columns=["batch", "part", "n"])

    tables = table.select("part", "entries", "n").groupBy("part")
    return tables.cogroup(asked.groupBy("part")).applyInPandas(run, "batch long, part int, n binary")


def counts_in(found: pd.DataFrame, entries: list[str], parts: int, width: int) -> np.ndarray:
    """A batch's answers as one row of counts for each entry it asked for."""
    out = np.zeros((len(entries), width), np.int64)
    got = dict(zip(found["part"], found["n"]))
    for p, own in dealt(entries, parts):
        n = unpacked_numbers(got.pop(p)).reshape(width, -1) if p in got else np.zeros((width, 0), np.int64)
        if n.shape[1] != len(own):
            raise RuntimeError("a batch did not get the entries it asked for; was the input changed meanwhile?")
        out[own] = n.T
    return out


def unseen_logs(words: list[str], grams: list[str], n: np.ndarray, totals: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The mean of the longest known n-grams' log frequencies, for words that no language knows."""
    known = n.any(axis=1)
    sizes = np.array([len(g) for g in grams], np.int64)
    logs = np.zeros(n.shape)
    for size in range(1, LONGEST + 1):
        own = known & (sizes == size)
        logs[own] = logs_of(n[own], totals[size], types[size], size)
    place = {grams[k]: k for k in np.flatnonzero(known)}
    out = np.zeros((len(words), n.shape[1]))
    for k, w in enumerate(words):
        longest = [next((place[g] for g in at if g in place), None) for at in places(f"^{w}$")]
        out[k] = logs[[x for x in longest if x is not None]].sum(axis=0) / len(longest)
    return out


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column | str]) -> DataFrame:
    """The columns in `keep`, then lang_pred and score of each row's whole text.

    Null texts and texts without a letter are `und` with score 0; so is everything if there was nothing to
    learn from. Ties go to the language that sorts first. Repeated rows are predicted each.
    """
    plain = docs.select(*keep)
    if not model.langs:
        return plain.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    text, batch, place, size, ids, words = fresh(plain, "text", "batch", "place", "size", "ids", "words")
    kept = docs.select(*keep, docs["text"].alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    langs, totals, types, parts, width = model.langs, model.totals, model.types, model.parts, len(model.langs)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts as places in the list of distinct words of a slice; both stand in the slice's first row."""
        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            texts = [t if isinstance(t, str) else "" for t in rows[text]]
            begin, chars = 0, 0
            for end, t in enumerate(texts, 1):
                chars += len(t)
                if chars < SLICE_CHARS and end < len(texts):
                    continue
                local: defaultdict[str, int] = defaultdict(count().__next__)
                found = []
                for own in map(letter_words, texts[begin:end]):
                    own = own if any(c.isalpha() for w in own for c in w) else []
                    found.append(np.fromiter(map(local.__getitem__, own), np.int64, len(own)))
                at, rest = np.concatenate(found), [None] * (end - begin - 1)
                sizes = np.array([len(x) for x in found], np.int64)
                # frequent words get low numbers, equally frequent ones stand in order, and so do a text's words: their
                # steps take less room
                seen = np.bincount(at, minlength=len(local)).tolist()
                names = sorted(local, key=lambda w: (-seen[local[w]], w))
                rank = np.empty(len(names), np.int64)
                rank[[local[w] for w in names]] = np.arange(len(names))
                text_of = np.repeat(np.arange(len(sizes)) << 32, sizes)
                steps = np.diff(np.sort(text_of + rank[at]) - text_of, prepend=0)
                yield rows.iloc[begin:end].drop(columns=text).assign(**{
                    batch: number, place: np.arange(end - begin), size: sizes,
                    ids: [packed_numbers(steps), *rest], words: [packed(names) if names else None, *rest],
                })
                number, begin, chars = number + 1, end, 0

    whole = f"{schema}, `{batch}` long, `{place}` int, `{size}` long, `{ids}` binary, `{words}` binary"
    read = staged(kept.mapInPandas(split, whole), "language-slices")
    heads = read.where(F.col(words).isNotNull()).select(F.col(batch).alias("batch"), F.col(words).alias("words"))

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for heads in batches:
            for name, own in zip(heads["batch"], heads["words"]):
                yield asked_of(name, unpacked(own), parts)

    def ask_grams(heads: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = unpacked(heads["words"].iloc[0])
        unseen = ~counts_in(found, own, parts, width).any(axis=1)
        return asked_of(heads["batch"].iloc[0], grams_of([own[k] for k in np.flatnonzero(unseen)]), parts)

    by_words = staged(answers(heads.mapInPandas(ask_words, ASKED), model.words, model.columns), "language-answers")
    of_unseen = heads.groupBy("batch").cogroup(by_words.groupBy("batch")).applyInPandas(ask_grams, ASKED)
    by_grams = answers(of_unseen, model.grams, model.columns)
    found = by_words.withColumn("grams", F.lit(False)).unionAll(by_grams.withColumn("grams", F.lit(True)))

    def scored(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        sizes, labels, scores = rows[size].to_numpy(), np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
        if sizes.any():
            own = unpacked(rows[words].iloc[0])
            n = counts_in(found[~found["grams"]], own, parts, width)
            logs = logs_of(n, totals[0], types[0], 0)
            unseen = np.flatnonzero(~n.any(axis=1))
            if len(unseen):
                rare = [own[k] for k in unseen]
                grams = grams_of(rare)
                logs[unseen] = unseen_logs(rare, grams, counts_in(found[found["grams"]], grams, parts, width), totals, types)
            some = np.flatnonzero(sizes)
            begins = np.cumsum(sizes[some]) - sizes[some]
            total = np.add.reduceat(logs[np.cumsum(unpacked_numbers(rows[ids].iloc[0]))], begins, axis=0)
            weights = np.exp(total - total.max(axis=1, keepdims=True))
            best = total.argmax(axis=1)
            labels[some] = np.array(langs, object)[best]
            scores[some] = weights[np.arange(len(some)), best] / weights.sum(axis=1)
        return rows.drop(columns=[batch, place, size, ids, words]).assign(lang_pred=labels, score=scores)

    return read.groupBy(batch).cogroup(found.groupBy("batch")).applyInPandas(scored, f"{schema}, lang_pred string, score double")
