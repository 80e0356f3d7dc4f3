"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs the votes.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). How often a rule
votes each way for good and for bad texts is not known; it is estimated from the votes of the whole
corpus. The estimate needs only how often each combination of votes occurs, at most 3^8 counters
however large the corpus is. A text stays if its posterior probability of being good is high enough.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.llm.common import fresh, join_rows, let, row_hash, words
from unisource.session import staged

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
VOTES = (-1, 0, 1)

# What a rule is taken to do before any text was seen, as shares of its votes for good and for bad texts, and
# how much that counts against the corpus: so many texts for each one of it, and so many at least.
PRIOR_GOOD = {-1: 0.002, 0: 0.148, 1: 0.85}
PRIOR_BAD = {-1: 0.2, 0: 0.05, 1: 0.75}
PRIOR_GOOD_SHARE = 0.9
PRIOR_WEIGHT, PRIOR_LEAST = 1.0, 10.0
ROUNDS = 50


def base_measures(text: Column) -> list[Column]:
    """Counts of a text: words, their code points, symbols, repeated lines, distinct words, and more."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return [
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(full, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, string.ascii_uppercase, ""))).alias("n_upper"),
        (F.length(full) - F.length(F.translate(full, ".,;:?", ""))).alias("n_stops"),
        lines.alias("lines"),
        words(text).alias("words"),
    ]


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of 8 that occur again in the same array of word hashes."""

    def marked(ranked: Column) -> Column:
        again = F.filter(ranked, lambda s, j: s["h"].eqNullSafe(F.get(ranked, j - 1)["h"]) | s["h"].eqNullSafe(F.get(ranked, j + 1)["h"]))
        return F.sort_array(F.transform(again, lambda s: s["i"]))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def counted(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(ranked, marked), covered)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) > WINDOW, let(windows, counted)).otherwise(0)


def measures(docs: DataFrame, keep: Iterable[str]) -> DataFrame:
    """The columns in `keep` and a struct of measures, under a name that is returned last.

    The windows of 8 words are compared by 64-bit hashes within one text. Texts without a repeated
    window, nearly all of them, never sort anything.
    """
    keep = list(keep)
    (out,) = fresh(docs, "measures")
    kept = F.struct(*[docs[c] for c in keep]).alias("row")
    base = docs.select(kept, *base_measures(docs["text"]))
    lines = F.col("lines")
    found = let(F.transform("words", lambda w: F.xxhash64(w)), lambda hashes: F.struct(
        F.size(hashes).cast("long").alias("n_words"), F.col("word_chars"), F.col("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(hashes).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"),
        F.col("n_upper").cast("long").alias("n_upper"), F.col("n_stops").cast("long").alias("n_stops"),
    ))
    return base.select("row.*", found.alias(out))


def rules(m: Column) -> dict[str, Column]:
    """The votes by rule. `m` is a struct of measures."""
    n = m["n_words"]
    chars = m["word_chars"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(n < 20, n >= 50),
        "word_length": vote((chars < 3 * n) | (chars > 8 * n), (chars >= 4 * n) & (10 * chars <= 65 * n)),
        "symbols": vote(10 * m["n_symbols"] > n, 100 * m["n_symbols"] <= n),
        "lines": vote((m["n_dup_lines"] > 2) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]), (m["n_lines"] > 1) & (10 * m["n_dup_lines"] <= m["n_lines"])),
        "repeats": vote((m["n_repeat_words"] > 40) & (100 * m["n_repeat_words"] > 20 * n), 100 * m["n_repeat_words"] <= 5 * n),
        "variety": vote((n <= 2000) & (10 * m["n_distinct"] < 3 * n), 2 * m["n_distinct"] >= n),
        "capitals": vote(2 * m["n_upper"] > chars, 5 * m["n_upper"] <= chars),
        "stops": vote((n >= 20) & ((50 * m["n_stops"] < n) | (m["n_stops"] > n)), (20 * m["n_stops"] >= n) & (2 * m["n_stops"] <= n)),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


@dataclass(frozen=True)
class VoteModel:
    """Share of good texts, and of each rule the share of its votes for good and for bad texts."""

    good_share: float
    given_good: dict[str, dict[int, float]]
    given_bad: dict[str, dict[int, float]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability that a text is good, 0 to 1."""
        logit = F.lit(math.log(self.good_share / (1 - self.good_share)))
        for name, vote in votes.items():
            weight = {v: math.log(self.given_good[name][v] / self.given_bad[name][v]) for v in VOTES}
            logit = logit + F.when(vote == -1, weight[-1]).when(vote == 1, weight[1]).otherwise(weight[0])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def maximise(names: list[str], counted: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over combinations of votes and how often they occur.

    Starts from "any bad vote makes a text suspicious". A rule may not turn round: its bad votes stay
    at least as likely for bad texts as for good ones. Without rows the prior decides.
    """
    counted = sorted(counted)
    good = [0.1 if -1 in votes else 0.95 for votes, _ in counted]
    total = sum(c for _, c in counted)
    prior = PRIOR_LEAST + PRIOR_WEIGHT * total
    for _ in range(rounds):
        ones = sum(g * c for g, (_, c) in zip(good, counted))
        share = (ones + PRIOR_GOOD_SHARE * prior) / (total + prior)
        given_good, given_bad = {}, {}
        for k, name in enumerate(names):
            up = {v: x * prior for v, x in PRIOR_GOOD.items()}
            down = {v: x * prior for v, x in PRIOR_BAD.items()}
            for g, (votes, c) in zip(good, counted):
                up[votes[k]] += g * c
                down[votes[k]] += (1 - g) * c
            up = {v: x / sum(up.values()) for v, x in up.items()}
            down = {v: x / sum(down.values()) for v, x in down.items()}
            if up[-1] > down[-1]:
                up = down = {v: (up[v] + down[v]) / 2 for v in VOTES}
            given_good[name], given_bad[name] = up, down
        good = []
        for votes, _ in counted:
            logit = math.log(share / (1 - share)) + sum(
                math.log(given_good[n][v] / given_bad[n][v]) for n, v in zip(names, votes)
            )
            good.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
    return VoteModel(share, given_good, given_bad)


def fit(measured: DataFrame, column: str) -> VoteModel:
    """The model of a table of measures. The driver gets at most 3^8 counters."""
    votes = rules(F.col(column))
    counted = measured.groupBy(*[v.alias(f"v{k}") for k, v in enumerate(votes.values())]).count().collect()
    return maximise(list(votes), [(tuple(r[:-1]), r[-1]) for r in counted])


def score(docs: DataFrame, keep: Iterable[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """The columns in `keep` (default: all), a struct `quality` and the verdict `kept` for each row.

    Null and empty texts have no words and fail; repeated rows get the same verdict each; an empty
    table gives no rows. Columns called like the new ones must be left out of `keep`.
    Measures are written once, the model and the verdicts read them from there.
    """
    keep = list(docs.columns if keep is None else keep)
    measured = measures(docs, keep)
    column = measured.columns[-1]
    table = staged(measured, "quality")
    model = fit(table, column)
    m = table[column]
    posterior = model.posterior(rules(m))
    quality = F.struct(m.alias("measures"), posterior.alias("probability"), base_failed(m).alias("base_failed"))
    verdict = (~base_failed(m)) & (posterior >= threshold)
    return table.select(*[table[c] for c in keep], quality.alias("quality"), verdict.alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The rows of `docs` that pass, with the columns they had.

    Only keys and measures are staged; texts meet the verdicts by id and hash.
    """
    (row,) = fresh(docs, "row")
    scored = score(docs.select("doc_id", row_hash(docs["text"]).alias(row), "text"), ["doc_id", row], threshold)
    good = scored.where("kept").select("doc_id", row).distinct()
    keyed = docs.withColumn(row, row_hash(docs["text"]))
    return join_rows(keyed, good, "left_semi", ("doc_id", row)).drop(row)
