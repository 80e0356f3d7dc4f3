"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform share.

Counts travel as packed arrays. Each batch of documents asks for the counts of its distinct keys, with its own
training occurrences beside them; keys are dealt to parts by hash. A part adds up the occurrences of
all batches and answers each with the totals in the order asked, so one exchange both counts and looks up, and no
key, however frequent, costs more than one number per batch. The mixture weights depend on how often
the context was seen; they are learned by expectation-maximisation on a deleted part of the training
rows, from the counts of the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.llm.arrays import MIX, WordHasher, mixed
from unisource.llm.common import row_hash
from unisource.session import staged

END = np.uint64(0x5BD1E9955BD1E995)  # stands after each text
START = np.uint64(0x27D4EB2F165667C5)  # the context of a text's first word
BUCKETS = 24  # contexts by the power of two of their count
PART_CHARS = 8_000_000  # a part of keys is for about so many characters of text
SLICE_CHARS = 1_000_000  # texts of an Arrow batch that are looked at together, by characters; a token costs some 200 bytes
ROUNDS = 30
GRID = 4.0  # held-out probabilities are counted in steps of a quarter power of two


@dataclass(frozen=True)
class Tokens:
    """The tokens of a batch: hashes, the text each belongs to, and the places of its distinct keys."""

    doc: np.ndarray
    keys: np.ndarray  # distinct words, the start and distinct pairs, sorted by part
    parts: np.ndarray  # part of each key
    word: np.ndarray  # place of each token's own key
    context: np.ndarray
    pair: np.ndarray


def tokens_of(texts: list[str | None], parts: int, hasher: WordHasher) -> Tokens:
    word, doc = [], []
    for k, text in enumerate(texts):
        own = hasher(text)
        word.append(np.append(own, END))
        doc.append(np.full(len(own) + 1, k))
    if not word:
        empty = np.zeros(0, np.int64)
        return Tokens(empty, np.zeros(0, np.uint64), empty, empty, empty, empty)
    w, d = np.concatenate(word), np.concatenate(doc)
    first = np.append(True, d[1:] != d[:-1])
    before = np.append(START, w[:-1])
    before[first] = START
    # a context is the word before or the start, so only words and pairs are told apart
    word_place, words = pd.factorize(w)
    pair_place, pairs = pd.factorize(mixed(before * MIX + w) ^ np.uint64(1))
    keys = mixed(np.concatenate([words, [START], pairs]))
    context_place = np.where(first, len(words), np.append(0, word_place[:-1]))
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Tokens(d, keys[order], part[order], back[word_place], back[context_place], back[pair_place + len(words) + 1])


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut by characters; the same batch is always cut at the same rows. A long text is a slice of its own."""
    for batch in batches:
        chars = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch["text"]], dtype=np.int64)
        for _, own in batch.groupby(chars // SLICE_CHARS, sort=True):
            yield own.reset_index(drop=True)


def batch_name(batch: pd.DataFrame) -> int:
    """A batch's name follows from its rows, so asking and scoring agree or fail, never mix.

    Batches of the same rows share a name: they ask for the same counts and are told apart by number only.
    """
    text = ",".join(":".join(map(str, x)) for x in zip(*[batch[c] for c in ("doc_id", "row", "train", "held_out", "deleted")]))
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def requests(docs: DataFrame, parts: int, learning: bool) -> DataFrame:
    """part, batch, keys, counts (training occurrences in the batch), packed; `learning` marks the deleted part.

    A batch is bounded in characters, so its own counts fit 32 bits; sums over batches have 64.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(lower=True)
        for batch in slices(batches):
            t = tokens_of(list(batch["text"]), parts, hasher)
            train = batch["train"].to_numpy(bool)[t.doc] if len(t.doc) else np.zeros(0, bool)
            starts = np.zeros(len(t.keys), np.int64)
            first = np.append(True, t.doc[1:] != t.doc[:-1]) & train if len(t.doc) else train
            np.add.at(starts, t.context[first], 1)
            seen = np.bincount(t.word[train], minlength=len(t.keys)) + np.bincount(t.pair[train], minlength=len(t.keys)) + starts
            is_word = np.zeros(len(t.keys), bool)
            is_word[t.word] = True
            edges = np.flatnonzero(np.append(True, t.parts[1:] != t.parts[:-1])) if len(t.keys) else np.zeros(0, int)
            ends = np.append(edges[1:], len(t.keys))
            name = batch_name(batch)
            yield pd.DataFrame([
                (int(t.parts[a]), name, t.keys[a:b].tobytes(), seen[a:b].astype("<u4").tobytes(), np.packbits(is_word[a:b]).tobytes())
                for a, b in zip(edges, ends)
            ], columns=["part", "batch", "keys", "counts", "is_word"])

    asked = docs.mapInPandas(run, "part int, batch long, keys binary, counts binary, is_word binary")
    return asked.withColumn("learning", F.lit(learning))


def answers(asked: DataFrame) -> DataFrame:
    """part, batch, counts (over all batches, in the order asked), kept (the same without the deleted part, for its batches).

    One row more per part has its numbers of tokens and types, with and without the deleted part.
    """
    names = ["part", "batch", "counts", "kept", "n_tokens", "n_types", "kept_tokens", "kept_types"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in part["keys"]]
        sizes = np.array([len(k) for k in keys])
        place, distinct = pd.factorize(np.concatenate(keys))
        total, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        is_word = np.zeros(len(distinct), bool)
        ends = np.cumsum(sizes)
        for e, n, c, w, learning in zip(ends, sizes, part["counts"], part["is_word"], part["learning"]):
            own = place[e - n : e]  # the keys of one batch are distinct
            counts = np.frombuffer(c, "<u4")
            total[own] += counts
            if not learning:
                kept[own] += counts
            is_word[own[np.unpackbits(np.frombuffer(w, np.uint8), count=n).astype(bool)]] = True
        p = part["part"].iloc[0]
        rows = [
            (p, b, total[place[e - n : e]].astype("<i8").tobytes(), kept[place[e - n : e]].astype("<i8").tobytes() if learning else b"", 0, 0, 0, 0)
            for b, e, n, learning in zip(part["batch"], ends, sizes, part["learning"])
        ]
        numbers = [int(x) for c in (total, kept) for x in (c[is_word].sum(), (c[is_word] > 0).sum())]
        return pd.DataFrame([*rows, (p, -1, b"", b"", *numbers)], columns=names)

    schema = "part int, batch long, counts binary, kept binary, n_tokens long, n_types long, kept_tokens long, kept_types long"
    return asked.groupBy("part").applyInPandas(run, schema)


@dataclass(frozen=True)
class Mixture:
    """Training tokens and types, and by context bucket the weights of bigram, unigram and uniform."""

    tokens: int
    types: int
    weights: np.ndarray

    def parts(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Maximum-likelihood estimates, one row each; 0 where nothing was seen."""
        two = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        one = word / max(self.tokens, 1)
        return np.stack([two, one, np.full(len(two), 1.0 / (self.types + 1))])


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1)).astype(int), BUCKETS - 1)


def looked_up(docs: DataFrame, found: DataFrame, parts: int, run, schema: str, which: str = "counts") -> DataFrame:
    """Apply run(batch, tokens, counts) to each batch and the counts it asked for; `which` are they."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield batch.assign(batch=batch_name(batch), place=np.arange(len(batch)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInPandas(named, f"doc_id {kind}, row long, text string, train boolean, held_out boolean, deleted boolean, batch long, place int")

    def both(batch: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return run(batch, None, None)
        # batches of one name have the same rows and got the same answers: one is looked up for all
        names = len(batch)
        batch = batch.drop_duplicates("place").sort_values("place")
        copies = names // len(batch)
        t = tokens_of(list(batch["text"]), parts, WordHasher(lower=True))
        total = np.frombuffer(b"".join(counts.drop_duplicates("part").sort_values("part")[which]), "<i8")
        if len(total) != len(t.keys):
            raise RuntimeError("the counts of a batch are not those it asked for; was the input changed meanwhile?")
        return pd.concat([run(batch, t, total)] * copies)

    return rows.groupBy("batch").cogroup(found.where("batch >= 0").select("part", "batch", which).groupBy("batch")).applyInPandas(both, schema)


def held_out_cells(batch: pd.DataFrame, t: Tokens | None, total: np.ndarray | None, tokens: int, types: int) -> pd.DataFrame:
    """Deleted rows' tokens by context bucket and by steps of their bigram and unigram estimates.

    `total`, `tokens` and `types` are those of the other training rows: no word of a deleted row lends itself weight.
    """
    names = ["bucket", "two", "one", "n"]
    if t is None:
        return pd.DataFrame([], columns=names)
    use = batch["deleted"].to_numpy(bool)[t.doc]
    pair, context, word = (total[x][use] for x in (t.pair, t.context, t.word))
    model = Mixture(tokens, types, np.zeros((0, 3)))
    two, one, _ = model.parts(pair, context, word)
    with np.errstate(divide="ignore"):
        step = [np.where(p > 0, np.round(GRID * np.log2(np.where(p > 0, p, 1))), 999).astype(int) for p in (two, one)]
    cells, n = np.unique(np.stack([bucket(context), *step], axis=1), axis=0, return_counts=True)
    return pd.DataFrame({"bucket": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": n})


def learn(cells: pd.DataFrame, types: int) -> np.ndarray:
    """Weights by context bucket: expectation-maximisation over the held-out cells."""
    weights = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    for b, own in cells.groupby("bucket"):
        value = [np.where(own[c] == 999, 0.0, 2.0 ** (own[c].to_numpy(float) / GRID)) for c in ("two", "one")]
        p = np.stack([*value, np.full(len(own), 1.0 / (types + 1))])
        n = own["n"].to_numpy(float)
        w = weights[b]
        for _ in range(ROUNDS):
            share = w[:, None] * p
            share = share / share.sum(axis=0)
            w = (share * n).sum(axis=1) + np.array([0.1, 0.1, 1.0])  # the uniform share never vanishes
            w = w / w.sum()
        weights[b] = w
    return weights


def lm_scores(docs: DataFrame, train: Column, held_out: Column, deleted: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    `train` marks the rows to count, `deleted` those of them that the weights are learned on. A null or
    empty text is its end token only; repeated rows count and are scored each; an empty table gives no rows.
    Without training rows all words are unseen.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(16, chars // PART_CHARS))
    read = docs.select(
        "doc_id", row_hash(docs["text"]).alias("row"), "text", train.alias("train"), held_out.alias("held_out"),
        (train & deleted).alias("deleted"),
    )
    learning, other = read.where("deleted"), read.where("not deleted")
    found = staged(answers(requests(learning, parts, True).unionAll(requests(other, parts, False))), "counts")
    sums = found.where("batch = -1").agg(*[F.sum(c) for c in ("n_tokens", "n_types", "kept_tokens", "kept_types")]).first()
    tokens, types, kept_tokens, kept_types = (int(x or 0) for x in sums)

    cells = looked_up(
        learning, found, parts, lambda b, t, c: held_out_cells(b, t, c, kept_tokens, kept_types),
        "bucket int, two int, one int, n long", "kept",
    )
    table = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).orderBy("bucket", "two", "one").toArrow().to_pandas()
    model = Mixture(tokens, types, learn(table, kept_types))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(batch: pd.DataFrame, t: Tokens | None, total: np.ndarray | None) -> pd.DataFrame:
        if t is None:
            return pd.DataFrame([], columns=names)
        pair, context, word = total[t.pair], total[t.context], total[t.word]
        estimates = model.parts(pair, context, word)
        p = (model.weights[bucket(context)].T * estimates).sum(axis=0)
        base = np.log10((word + 1) / (tokens + types + 1))
        size = len(batch)
        return pd.DataFrame({
            "doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"].to_numpy(),
            "n_tokens": np.bincount(t.doc, minlength=size), "n_known": np.bincount(t.doc, weights=word > 0, minlength=size).astype(np.int64),
            "train_tokens": np.full(size, tokens, np.int64),
            "base_score": np.bincount(t.doc, weights=base, minlength=size), "score": np.bincount(t.doc, weights=np.log10(p), minlength=size),
        }, columns=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return looked_up(learning, found, parts, scored, schema).unionAll(looked_up(other, found, parts, scored, schema))
