"""Phrases whose words come together far more often than apart, counted by weighted acyclic automata.

* A shard of documents sorts its n-grams and builds a count transducer from them: an acyclic automaton that reads
  words, with the occurrences of the phrase read so far on its arcs. States with the same single arc are one state.
* Transducers are cut at the borders of prefix ranges. All parts of one language and range meet in one task, which
  unites them and sums their weights. Only phrases of the asked frequency leave it, and those that a border cuts,
  whose sums are completed afterwards.
* Parts of phrases are looked up by composition: the frequent phrases of a range are built into a transducer once more, and the
  cut phrases whose first or last part lies in that range are run through it.

Borders come from a bounded sample of phrases. They decide where a phrase is counted, never whether.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unisource.session import staged

LONGEST = 4  # words of a phrase
SHARD_WORDS = 1 << 20  # words that a task holds before it builds a transducer of them
RANGE_BYTES = 4 << 20  # text per prefix range
MAX_RANGES = 100_000
HELD_BYTES = 10 << 20  # transducers of a range that a task holds before it unites them
SPARE = 8  # partitions for languages that the sample of borders did not meet
SAMPLES = 20  # sampled phrases per range
UNKNOWN = "und"
#: Ends a piece of a text. No word contains it, since it is one of the characters that separate pieces.
BREAK = b"."
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + SEPARATORS + b"\t", bytes(range(ord("a"), ord("z") + 1)) + BREAK * len(SEPARATORS) + b" "
)
Phrase = tuple[bytes, ...]
#: By language, in order: the first phrase of every prefix range but the first.
Borders = dict[str, list[Phrase]]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, with BREAK between pieces."""
    if not isinstance(text, str):
        return []
    return text.encode("utf-8", "surrogatepass").translate(FOLD).replace(BREAK, b" . ").split()


def spelled(phrase: Phrase | list[bytes]) -> str:
    return b" ".join(phrase).decode("utf-8", "surrogatepass")


def phrase_of(text: str) -> Phrase:
    return tuple(text.encode("utf-8", "surrogatepass").split(b" "))


# ---- phrases as rows of numbers: places of their words in a sorted list, -1 behind the end ----


def packed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each row, in the order of the rows; a phrase comes before all that it begins."""
    a, b, c, d = ((rows[:, k] + 1).astype(np.uint64) for k in range(LONGEST))
    return (a << np.uint64(32)) | b, (c << np.uint64(32)) | d


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, equal ones once with the sum of their counts."""
    high, low = packed(rows)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(rows)])
    return rows[order[starts]], np.add.reduceat(counts[order], starts) if len(rows) else counts


def only_used(words: list[bytes], rows: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words that occur in rows, and the rows with the places among these."""
    seen = np.zeros(len(words) + 1, bool)
    seen[rows] = True
    seen[-1] = False
    place = np.append(np.cumsum(seen[:-1]) - 1, -1).astype(np.int32)
    return [words[i] for i in np.flatnonzero(seen).tolist()], place[rows]


# ---- the transducers ----


@dataclass
class Automaton:
    """An acyclic automaton that reads phrases word by word, with the weight of what has been read on its arcs.

    Level d holds the arcs that read word d: label (place in `words`, which are in order), weight and target (a
    state of the next level). The arcs of a level's state s lie from first[s] to before first[s + 1], in order. Target 0 is
    the state without arcs; reading begins in state 1. States with one equal arc each are one state.
    """

    words: list[bytes]
    first: list[np.ndarray]
    label: list[np.ndarray]
    weight: list[np.ndarray]
    target: list[np.ndarray]

    def arcs(self, d: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the arcs of some states of level d, one state after another, and how many each has."""
        low = self.first[d][states]
        n = self.first[d][states + 1] - low
        return np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum())), n

    def phrases(self, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All phrases that can be read over arcs of some weight at least, and their weights."""
        out, weights = [], []
        paths = np.full((1, LONGEST), -1, np.int32)
        states = np.ones(1, np.int64)
        for d in range(LONGEST):
            arcs, n = self.arcs(d, states)
            heavy = self.weight[d][arcs] >= least
            arcs = arcs[heavy]
            paths = paths[np.repeat(np.arange(len(paths)), n)[heavy]]
            paths[:, d] = self.label[d][arcs]
            states = self.target[d][arcs].astype(np.int64)
            out.append(paths)
            weights.append(self.weight[d][arcs].astype(np.int64))
        return np.concatenate(out), np.concatenate(weights)

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """The weight after reading each phrase, all at once level by level; 0 where one cannot be read."""
        states = np.ones(len(rows), np.int64)
        weights = np.zeros(len(rows), np.int64)
        span = len(self.words) + 1
        for d in range(LONGEST):
            on = np.flatnonzero((rows[:, d] >= 0) & (states > 0))
            owner = np.repeat(np.arange(len(self.first[d]) - 1), np.diff(self.first[d]))
            keys = owner * span + self.label[d]
            wanted = states[on] * span + rows[on, d]
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            read = keys[at] == wanted if len(keys) else np.zeros(len(on), bool)
            weights[on] = np.where(read, self.weight[d][at] if len(keys) else 0, 0)
            states[on] = np.where(read, self.target[d][at] if len(keys) else 0, 0)
            lost = on[~read]
            states[lost], weights[lost] = 0, 0
            # a phrase that goes on behind the last arc cannot be read
            if d + 1 < LONGEST:
                weights[(rows[:, d + 1] >= 0) & (states == 0)] = 0
        return weights

    def rows_of(self, phrases: list[Phrase]) -> np.ndarray:
        """Phrases as rows; a word that no arc reads has a number that no arc has."""
        place = {w: i for i, w in enumerate(self.words)}
        rows = np.full((len(phrases), LONGEST), -1, np.int32)
        for i, phrase in enumerate(phrases):
            rows[i, : len(phrase)] = [place.get(w, len(self.words)) for w in phrase]
        return rows


Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # arc of the level before that leads there, label, weight of each arc, in order


def build(words: list[bytes], levels: list[Level]) -> Automaton:
    """The transducer of phrases in order, from its arcs by level.

    States are frozen from the ends on: when those of one level are made, all that they lead to are final, and
    states with one equal arc become one.
    """
    first, label, weight, target = ([None] * LONGEST for _ in range(4))
    leads_to = np.zeros(len(levels[-1][0]), np.int64)
    for d in reversed(range(LONGEST)):
        parents, labels, weights = levels[d]
        n = np.bincount(parents, minlength=len(levels[d - 1][0]) if d else 1)
        single, several = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
        at = (np.cumsum(n) - n)[single]
        kept, number = distinct(labels[at], weights[at], leads_to[at])
        kept = at[kept]
        state = np.zeros(len(n), np.int64)
        state[single] = 1 + number
        state[several] = 1 + len(kept) + np.arange(len(several))
        rest = np.flatnonzero(np.repeat(n > 1, n))
        arcs = np.concatenate([kept, rest])
        first[d] = np.cumsum(np.concatenate([[0, 0], np.ones(len(kept), np.int64), n[several]]))
        label[d], weight[d], target[d] = labels[arcs].astype(np.int32), weights[arcs].astype(np.int64), leads_to[arcs]
        leads_to = state
    if len(first[0]) < 3:
        first[0] = np.zeros(3, np.int64)
    return Automaton(words, first, label, weight, target)


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different row, and the number of each row's kind."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = [int(c.max()) + 1 for c in columns]
    if spans[0] * spans[1] * spans[2] < 1 << 63:
        key = (columns[0].astype(np.int64) * spans[1] + columns[1]) * spans[2] + columns[2]
        _, kept, number = np.unique(key, return_index=True, return_inverse=True)
        return kept, number
    order = np.lexsort(columns)
    new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def levels_of_windows(rows: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Arcs of sorted, different windows: each beginning of a window occurs as often as the windows that it begins."""
    change = np.zeros(len(rows), bool)
    out, before = [], np.zeros(1, np.int64)
    for d in range(LONGEST):
        change[:1] = True
        change[1:] |= rows[1:, d] != rows[:-1, d]
        starts = np.flatnonzero(change)
        weights = np.add.reduceat(counts, starts) if len(starts) else counts
        real = rows[starts, d] >= 0
        starts = starts[real]
        out.append((np.searchsorted(before, starts, "right") - 1, rows[starts, d], weights[real]))
        before = starts
    return out


def of_phrases(entries: dict[Phrase, int]) -> Automaton:
    """The transducer that reads some phrases with their weights; beginnings that are not among them weigh 0."""
    whole = sorted(({p[:d]: 0 for p in entries for d in range(1, len(p))} | entries).items())
    words = sorted({w for p, _ in whole for w in p})
    place = {w: i for i, w in enumerate(words)}
    number: dict[Phrase, int] = {(): 0}
    levels = []
    for d in range(1, LONGEST + 1):
        own = [(p, f) for p, f in whole if len(p) == d]
        arcs = [(number[p[:-1]], place[p[-1]], f) for p, f in own]
        levels.append(tuple(np.array(arcs, np.int64).reshape(-1, 3).T))
        number |= {p: i for i, (p, _) in enumerate(own)}
    return build(words, levels)


def united(dumps: list[bytes]) -> Automaton:
    """One transducer with the summed weights of several, each as `dump` gives it.

    All are read side by side, level by level: arcs with the same word behind the same beginning are one arc.
    """
    automata = [load(d) for d in dumps]
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i for i, w in enumerate(words)}
    codes = [np.fromiter(map(place.__getitem__, a.words), np.int64, len(a.words)) for a in automata]
    states, behind = [np.ones(1, np.int64) for _ in automata], [np.zeros(1, np.int64) for _ in automata]
    span = max(1, len(words))
    levels = []
    for d in range(LONGEST):
        keys, weights = [], []
        for k, a in enumerate(automata):
            arcs, n = a.arcs(d, states[k])
            keys.append(np.repeat(behind[k], n) * span + codes[k][a.label[d][arcs]])
            weights.append(a.weight[d][arcs].astype(np.int64))
            states[k] = a.target[d][arcs].astype(np.int64)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        one, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(one), np.int64)
        np.add.at(total, number, np.concatenate(weights))
        levels.append((one // span, one % span, total))
        behind = np.split(number, cuts)
    return build(words, levels)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def dump(a: Automaton) -> bytes:
    parts = [[narrow(x) for x in group] for group in ([np.diff(f) for f in a.first], a.label, a.weight, a.target)]
    return pickle.dumps((b" ".join(a.words), parts), protocol=5)


def load(data: bytes) -> Automaton:
    words, (sizes, label, weight, target) = pickle.loads(data)
    first = [np.append(0, np.cumsum(s, dtype=np.int64)) for s in sizes]
    return Automaton(words.split(b" ") if words else [], first, label, weight, target)


# ---- prefix ranges ----


def part_of(phrase: Phrase, borders: list[Phrase]) -> int:
    """The range that a phrase lies in as a whole."""
    return bisect_right(borders, phrase)


def dealt(rows: DataFrame, borders: Borders, *order: str) -> DataFrame:
    """Rows with lang and part by range, one range after another in a task.

    Languages whose borders are known have a partition for each of their ranges, the others share some by hash.
    """
    sizes = {lang: len(own) + 1 for lang, own in sorted(borders.items())}
    ranges = sum(sizes.values())
    begin = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
    place = F.pmod(F.crc32(F.col("lang").cast("binary")), F.lit(SPARE)) + ranges
    if begin:
        known = F.create_map(*[F.lit(x) for pair in begin.items() for x in pair])
        place = F.coalesce(known[F.col("lang")] + F.col("part"), place)
    return rows.repartitionById(ranges + SPARE, place.cast("int")).sortWithinPartitions("lang", "part", *order)


def cut(words: list[bytes], rows: np.ndarray, borders: list[Phrase]) -> list[int]:
    """Places in sorted rows where the ranges begin, but for the first."""
    high, low = packed(rows)
    out = []
    for border in borders:
        codes = []
        for word in border:
            codes.append(bisect_left(words, word))
            if codes[-1] == len(words) or words[codes[-1]] != word:
                break  # the range begins with the next word there is
        codes += [-1] * (LONGEST - len(codes))
        a, b = (x[0] for x in packed(np.array([codes])))
        start, end = np.searchsorted(high, np.array([a, a + np.uint64(1)]))
        out.append(int(start + np.searchsorted(low[start:end], b)))
    return out


def sampled_borders(docs: DataFrame, range_bytes: int) -> Borders:
    """Borders that give ranges about the same share of the words of each language.

    The sample is by hash of the text and as large as the number of ranges asks for, MAX_RANGES at most.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("texts")).first()
    ranges = min(MAX_RANGES, -(-(total["bytes"] or 0) // range_bytes))
    if ranges < 2:
        return {}
    wanted = 2000 + ranges * SAMPLES
    share = max(1, 4 * total["texts"] // wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"]):
                found = tokens(text)
                for at in range(0, len(found), max(1, len(found) // 4)):
                    phrase = found[at : at + LONGEST]
                    phrase = phrase[: phrase.index(BREAK)] if BREAK in phrase else phrase
                    rows.append((lang, len(found), b" ".join(phrase)))
            yield pd.DataFrame(rows, columns=["lang", "size", "phrase"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInPandas(run, "lang string, size long, phrase binary")
    rows = [(r["lang"], tuple(bytes(r["phrase"]).split(b" ")), r["size"]) for r in some.where("length(phrase) > 0").limit(4 * wanted).collect()]
    weight = sum(size for *_, size in rows)
    borders: Borders = {}
    for lang in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == lang)
        sizes = np.cumsum([size for _, size in own])
        parts = max(1, round(ranges * int(sizes[-1]) / weight))
        at = np.searchsorted(sizes, np.arange(1, parts) * int(sizes[-1]) / parts)
        borders[lang] = sorted({own[i][0] for i in at.tolist()})
    return borders


# ---- counting ----


class Numbers(dict):
    """A number for each word, given when it is first seen; -1 for BREAK."""

    def __init__(self):
        super().__init__({BREAK: -1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number


def shard_parts(lang: str, codes: np.ndarray, begins: np.ndarray, vocabulary: list[bytes], borders: list[Phrase]) -> Iterator[tuple[str, int, bytes]]:
    """The transducer of a shard's phrases in one language, cut at the borders: language, range, data.

    `codes`: places in `vocabulary`, -1 at breaks; `begins` says which words may begin a phrase here.
    """
    at = np.flatnonzero(begins & (codes >= 0))
    if not len(at):
        return
    used = np.zeros(len(vocabulary), bool)
    used[codes[codes >= 0]] = True
    order = sorted(np.flatnonzero(used).tolist(), key=vocabulary.__getitem__)
    words = [vocabulary[i] for i in order]
    place = np.full(len(vocabulary) + 1, -1, np.int32)
    place[order] = np.arange(len(order))
    stream = np.append(place[codes], np.full(LONGEST, -1, np.int32))
    rows = np.column_stack([stream[at + d] for d in range(LONGEST)])
    for d in range(1, LONGEST):
        rows[rows[:, d - 1] < 0, d] = -1
    rows, counts = summed(rows, np.ones(len(rows), np.int64))
    places = [0, *cut(words, rows, borders), len(rows)]
    for part, (start, end) in enumerate(zip(places, places[1:])):
        if start < end:
            own, own_rows = only_used(words, rows[start:end])
            yield lang, part, dump(build(own, levels_of_windows(own_rows, counts[start:end])))


def transducers(docs: DataFrame, borders: Borders, shard_words: int) -> DataFrame:
    """lang, part, data: the transducers of every shard, cut into prefix ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, held, size = Numbers(), {}, 0

        def built() -> pd.DataFrame:
            vocabulary = list(numbers)[1:]
            return pd.DataFrame(
                [
                    row for lang, texts in held.items()
                    for row in shard_parts(lang, *(np.concatenate(x) for x in zip(*texts)), vocabulary, borders.get(lang, []))
                ],
                columns=["lang", "part", "data"],
            )

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = tokens(text)
                for at in range(0, len(found), shard_words):
                    some = found[at : at + shard_words + LONGEST - 1]
                    codes = np.fromiter(map(numbers.__getitem__, some), np.int32, len(some))
                    # words of the next stretch end phrases of this one and begin none
                    held.setdefault(lang, []).append((np.append(codes, np.int32(-1)), np.arange(len(some) + 1) < shard_words))
                    size += len(some)
                    if size >= shard_words:
                        yield built()
                        numbers, held, size = Numbers(), {}, 0
        yield built()

    return docs.mapInPandas(run, "lang string, part int, data binary")


def range_counts(parts: DataFrame, borders: Borders, least: int) -> DataFrame:
    """lang, phrase, f: frequent phrases of each range; those that a border cuts have a row in each of their ranges.

    A row without a phrase has the number of words that begin a phrase in its range.
    """

    def counted(lang: str, part: int, whole: Automaton) -> pd.DataFrame:
        rows, weights = whole.phrases(least)
        out = [(lang, spelled([whole.words[i] for i in row if i >= 0]), f) for row, f in zip(rows.tolist(), weights.tolist())]
        near = borders.get(lang, [])[max(0, part - 1) : part + 1]
        torn = sorted({b[:d] for b in near for d in range(1, len(b))})
        if torn:
            out += [(lang, spelled(p), int(n)) for p, n in zip(torn, whole.compose(whole.rows_of(torn))) if 0 < n < least]
        return pd.DataFrame([*out, (lang, None, int(whole.weight[0].sum()))], columns=["lang", "phrase", "f"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size = None, [], 0
        for batch in batches:
            for lang, part, data in zip(batch["lang"], batch["part"], batch["data"]):
                if key != (lang, part):
                    if held:
                        yield counted(*key, united(held))
                    key, held, size = (lang, part), [], 0
                held.append(data)
                size += len(data)
                if size > HELD_BYTES + len(held[0]):
                    held = [dump(united(held))]
                    size = len(held[0])
        if held:
            yield counted(*key, united(held))

    return dealt(parts, borders).mapInPandas(run, "lang string, phrase string, f long")


# ---- parts of phrases ----


def answers(frequent: DataFrame, borders: Borders) -> DataFrame:
    """lang, phrase, a, k, side, f, longer: what the transducers of all ranges say about the parts of phrases.

    With k: f of the phrase's first k words (side 'l') or of the rest ('r'). Without: the phrase is part of one that is
    longer by a word and occurs `longer` times.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text, f in zip(batch["lang"], batch["phrase"], batch["f"]):
                phrase, own = phrase_of(text), borders.get(lang, [])
                rows.append((lang, part_of(phrase, own), False, text, f, None, None, None))
                for k in range(1, len(phrase)):
                    for side, piece in (("l", phrase[:k]), ("r", phrase[k:])):
                        rows.append((lang, part_of(piece, own), True, spelled(piece), f, text, k, side))
            yield pd.DataFrame(rows, columns=["lang", "part", "asks", "phrase", "f", "of", "k", "side"])

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, entries, whole = None, {}, None
        for batch in batches:
            for own, rows in batch.groupby(["lang", "part", "asks"]):
                if key != own[:2]:
                    key, entries, whole = own[:2], {}, None
                phrases = [phrase_of(p) for p in rows["phrase"]]
                if not own[2]:
                    entries.update(zip(phrases, rows["f"]))
                    continue
                if whole is None:
                    whole = of_phrases(entries)
                yield pd.DataFrame({
                    "lang": rows["lang"], "phrase": rows["of"], "a": rows["f"], "k": rows["k"], "side": rows["side"],
                    "f": whole.compose(whole.rows_of(phrases)), "longer": None,
                })
                part = rows[[o.count(" ") == len(p) for o, p in zip(rows["of"], phrases)]]
                yield pd.DataFrame({"lang": part["lang"], "phrase": part["phrase"], "a": None, "k": None, "side": None, "f": None, "longer": part["f"]})

    spread = frequent.mapInPandas(asked, "lang string, part int, asks boolean, phrase string, f long, of string, k int, side string")
    return dealt(spread, borders, "asks", "phrase").mapInPandas(answered, "lang string, phrase string, a long, k int, side string, f long, longer long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to 4 words of each language.

    `a`: occurrences within pieces of texts, `least` at least; `n`: the language's words. A phrase is
    cut in two where floor(2000000 * a / (l + r)) is smallest, then as early as possible; l and r are the occurrences of the two
    parts. Phrases inside a longer one of four fifths of their occurrences or more go. Order: score, a, then the phrase's bytes.
    A null lang is UNKNOWN. Null and empty texts have no words; repeated rows and ids count each; a
    language without such phrases, or an empty table, gives no rows.
    """
    read = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    borders = sampled_borders(read, range_bytes)
    found = range_counts(transducers(read, borders, shard_words), borders, least)
    counts = staged(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()), "phrases")
    said = answers(counts.where("phrase is not null"), borders)

    def cut_value(k: int, side: str) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")

    ks = range(1, LONGEST)
    whole = said.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *[cut_value(k, s) for k in ks for s in "lr"])
    # decimal, since products of counts may pass 64 bits
    own = whole.where("a is not null and (longer is null or cast(100 as decimal(3)) * cast(longer as decimal(20)) < cast(80 as decimal(3)) * cast(a as decimal(20)))")
    cuts = F.array(*[
        F.when(F.col(f"l{k}").isNotNull(), F.struct(
            F.expr(f"(cast(2000000 as decimal(7)) * cast(a as decimal(20))) div (cast(l{k} as decimal(20)) + cast(r{k} as decimal(20)))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
        )) for k in ks
    ])
    scored = own.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    words = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
