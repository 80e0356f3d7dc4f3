"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams of 4 and 5 characters. In how many toxic and other training texts each
n-gram stands is counted over all labelled rows. Their log ratios scale the features of a logistic regression,
which is fitted to a bounded sample of labelled rows; its bound is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
BUCKETS = 1 << BITS
SIZES = (4, 5)
#: Rows of each class the regression is fitted to at most: those with the lowest hash of their id.
MAX_FIT_ROWS = 2_000
STEPS = 80
SMOOTH = 1.0
BLOCK = 1 << 20  # features looked at together while fitting
RARE = 3  # n-grams in fewer labelled texts than this count for nothing


def features(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's n-grams; white space counts as one kind of blank, case as lower."""
    chars = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le"), np.uint32)
    found = []
    for n in SIZES:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    h = np.concatenate(found).astype(np.int64)
    # one place of each bucket survives in the scratch table; no sorting
    order = np.arange(len(h), dtype=np.int32)
    scratch[h] = order
    return h[scratch[h] == order]


def bucket_counts(labelled: DataFrame) -> pd.DataFrame:
    """bucket, toxic, other: labelled texts with each n-gram, over all rows; at most 2^20 rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scratch = np.zeros(BUCKETS, np.int32)
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[int(toxic), features(text, scratch)] += 1
        own = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": own, "toxic": seen[1, own], "other": seen[0, own]})

    rows = labelled.select("text", "toxic").mapInPandas(run, "bucket long, toxic long, other long")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow().to_pandas()


def sample(labelled: DataFrame, max_rows: int, docs: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the fitting sample, how many features each row has, and the features one after another.

    Of each class the `max_rows` rows with the lowest hash of their id; of a repeated id those with the lowest
    hash of their text, so that the driver never gets more rows. `labelled` has doc_id, toxic and text, or instead
    of the text its hash `row`; then the texts chosen are looked up in `docs`, where they lie.
    """
    marked = labelled if docs is not None else labelled.withColumn("row", F.xxhash64("text"))
    docs = labelled if docs is None else docs
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("row")]
    chosen = [r for c in (0, 1) for r in marked.where(F.col("toxic") == c).orderBy(*order).limit(max_rows).collect()]
    keys = docs.sparkSession.createDataFrame(list({(r["doc_id"], r["row"]) for r in chosen}), marked.select("doc_id", "row").schema)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(F.broadcast(keys), ["doc_id", "row"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scratch = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            yield batch.drop(columns="text").assign(found=[features(t, scratch).astype("<i4").tobytes() for t in batch["text"]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = texts.dropDuplicates(["doc_id", "row"]).mapInPandas(run, f"doc_id {kind}, row long, found binary").toArrow()
    found = {
        (i, h): np.frombuffer(f.as_buffer(), "<i4")
        for i, h, f in zip(table["doc_id"].to_pylist(), table["row"].to_pylist(), table["found"])
    }
    labels, rows = [r["toxic"] for r in chosen], [found[r["doc_id"], r["row"]] for r in chosen]
    where = sorted(range(len(rows)), key=lambda k: (labels[k], rows[k][:16].tobytes()))
    flat = np.concatenate([rows[k] for k in where]) if rows else np.zeros(0, "<i4")
    return np.array([labels[k] for k in where], float), np.array([len(rows[k]) for k in where], np.int64), flat


@dataclass(frozen=True)
class ToxicityModel:
    """A weight for each bucket and an intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum(dtype=np.float64)) + self.intercept
        return 1 / (1 + np.exp(-min(max(margin, -60.0), 60.0)))


def regression(labels: np.ndarray, sizes: np.ndarray, flat: np.ndarray, ratios: np.ndarray, share: float) -> ToxicityModel:
    """Logistic regression on features scaled by `ratios`, by accelerated gradient steps.

    Both classes weigh the same while fitting; the intercept then moves half way to the true share of toxic rows.
    Features stay 32-bit buckets, whose scale is looked up, and are taken in blocks of rows.
    """
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + BLOCK, BLOCK)))
    cuts = np.unique(np.append(cuts[cuts < len(sizes)], [0, len(sizes)]))
    blocks = [(a, b, flat[ends[a] - sizes[a] : ends[b - 1]], np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]

    def margins(table: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[np.bincount(row, weights=table[own], minlength=b - a) for a, b, own, row in blocks]])

    used = np.zeros(BUCKETS, bool)
    used[flat] = True
    scale = np.where(used, ratios, 0.0)
    w, b = np.zeros(BUCKETS), 0.0
    # step from the largest curvature a row can have
    rate = 4 / (1 + (margins(scale**2) * weight).sum() / max(weight.sum(), 1e-9)) * 4
    ahead_w, ahead_b = w, b
    for k in range(STEPS):
        margin = margins(scale * ahead_w) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels)
        grad = 1e-5 * ahead_w
        for first, last, own, row in blocks:
            grad += scale * np.bincount(own, weights=error[first:last][row], minlength=BUCKETS)
        new_w, new_b = ahead_w - rate * grad, ahead_b - rate * error.sum()
        turn = k / (k + 3)
        ahead_w, ahead_b = new_w + turn * (new_w - w), new_b + turn * (new_b - b)
        w, b = new_w, new_b
    return ToxicityModel((w * scale).astype(np.float32), b + 0.5 * float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Learn from the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks.

    Null labels and labels other than 0 and 1 are left out; a document marked both ways counts both ways.
    Without labels of both classes every text gets the share of toxic rows as its score.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1)).distinct()
    # texts are dealt out once, for the counts; totals and sample need ids and hashes only. The labels grow with the
    # texts, so none is ever a table for every task and the cost is in proportion at any size.
    seen = bucket_counts(docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("row")).join(marks, "doc_id")
    totals = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    share = (toxic + 1) / (toxic + other + 2)
    ratios = np.zeros(BUCKETS)
    if toxic and other:
        p = (seen["toxic"].to_numpy() + SMOOTH) / (toxic + 2 * SMOOTH)
        q = (seen["other"].to_numpy() + SMOOTH) / (other + 2 * SMOOTH)
        common = (seen["toxic"] + seen["other"]).to_numpy() >= RARE
        ratios[seen["bucket"].to_numpy()] = np.where(common, np.log(p / q), 0.0)
    none = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, "<i4")
    return regression(*(sample(marked, max_rows, docs) if toxic and other else none), ratios, share)


def score(docs: DataFrame, model: ToxicityModel, keep: list[Column | str]) -> DataFrame:
    """The columns in `keep`, then the score of each row's whole text, 0 to 1.

    Null and empty texts have no n-grams, their score is the intercept's. Repeated rows are scored each.
    """
    kept = docs.select(*keep, docs["text"].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, scratch = shared.value, np.zeros(BUCKETS, np.int32)
        for batch in batches:
            scores = [own.score(features(t if isinstance(t, str) else "", scratch)) for t in batch["_text"]]
            yield batch.drop(columns="_text").assign(score=np.array(scores, float))

    return kept.mapInPandas(run, f"{schema}, score double")
