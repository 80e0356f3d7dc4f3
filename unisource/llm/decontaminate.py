"""Benchmark decontamination by winnowing.

Of each run of 6 consecutive 5-gram hashes the smallest is kept, in documents and items alike. A shared
span of 10 words holds 6 shared 5-grams, hence at least one fingerprint that both sides kept: joining
fingerprints misses no such span. A hit fixes how the document and the item lie against each other;
along that diagonal the words themselves are compared, so a hash collision adds nothing.
Items of fewer than 10 words are looked for as a whole, by one hash of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.llm.common import NOT_ALNUM, ascii_lower, fresh, join_rows, let, row_hash, words
from unisource.session import drop_shuffles, staged

SPAN = 10
GRAM = 5
RUN = SPAN - GRAM + 1
NO_PRINTS = "array<struct<m:int,h:bigint,pos:int>>"


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), NOT_ALNUM)


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def winnowed(hashes: Column) -> Column:
    """The kept fingerprints of an array of word hashes, with their places from 0."""

    def place(grams: Column, i: Column) -> Column:
        return let(F.slice(grams, i, RUN), lambda run: (i + F.array_position(run, F.array_min(run)) - 2).cast("int"))

    def kept(grams: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.size(grams) - (RUN - 1)), lambda i: place(grams, i))
        return F.transform(
            F.array_distinct(places), lambda p: F.struct(F.lit(SPAN).alias("m"), F.get(grams, p).alias("h"), p.alias("pos"))
        )

    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(hashes, i, GRAM)))
    return F.when(F.size(hashes) >= SPAN, let(grams, kept)).otherwise(F.array().cast(NO_PRINTS))


def whole_grams(hashes: Column, lengths: list[int]) -> Column:
    """Hashes of all word sequences of the given lengths."""
    if not lengths:
        return F.array().cast(NO_PRINTS)

    def of_length(m: int) -> Column:
        found = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - m),
            lambda i: F.struct(F.lit(m).alias("m"), F.xxhash64(F.slice(hashes, i + 1, m)).alias("h"), i.alias("pos")),
        )
        return F.when(F.size(hashes) >= m, found).otherwise(F.array().cast(NO_PRINTS))

    return F.concat(*[of_length(m) for m in lengths])


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items with words, one row each: item (a row key), item_id as text, words."""
    read = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), item_words(benchmark["text"]).alias("words"))
    return read.where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Occurrences of item windows: doc_id, row, item_id, start, length; places count words from 0."""
    items = items_of(benchmark)
    lengths = sorted(r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect())

    def item_prints(hashes: Column) -> Column:
        whole = F.array(F.struct(F.size(hashes).alias("m"), F.xxhash64(hashes).alias("h"), F.lit(0).alias("pos")))
        return F.when(F.size(hashes) < SPAN, whole).otherwise(winnowed(hashes))

    wanted = items.select("item", F.explode(let(word_hashes(F.col("words")), item_prints)).alias("p")).select(
        "item", F.col("p.m").alias("m"), F.col("p.h").alias("h"), F.col("p.pos").alias("at")
    ).distinct()

    keyed = docs.select("doc_id", row_hash(docs["text"]).alias("row"), item_words(docs["text"]).alias("words"))
    found = let(word_hashes(F.col("words")), lambda hashes: F.concat(winnowed(hashes), whole_grams(hashes, lengths)))
    prints = keyed.select("doc_id", "row", F.explode(found).alias("p"))
    hits = (
        prints.select("doc_id", "row", F.col("p.m").alias("m"), F.col("p.h").alias("h"), F.col("p.pos").alias("pos"))
        .join(wanted, ["m", "h"])
        .select("doc_id", "row", "item", (F.col("pos") - F.col("at")).alias("shift"))
        .distinct()
    )

    # extend each hit along its diagonal
    lined = hits.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    # the text travels as it is, an array of its words would be several times as large
    texts = docs.select("doc_id", row_hash(docs["text"]).alias("row"), docs["text"].alias("text"))
    met = join_rows(texts, lined).withColumn("words", item_words(F.col("text")))
    here = F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.size("item_words"))
    there = F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("words"))
    length = F.least(F.lit(SPAN), F.size("item_words"))

    def equal(here: Column, there: Column) -> Column:
        last = F.least(F.size(here), F.size(there)) - length
        return F.when(last >= 0, F.filter(
            F.sequence(F.lit(0), last), lambda i: F.slice(here, i + 1, length) == F.slice(there, i + 1, length)
        )).otherwise(F.array().cast("array<int>"))

    starts = let(F.struct(here.alias("here"), there.alias("there")), lambda x: equal(x["here"], x["there"]))
    return met.select(
        "doc_id", "row", "item_id", length.alias("length"), F.greatest("shift", F.lit(0)).alias("base"), F.explode(starts).alias("i")
    ).select("doc_id", "row", "item_id", (F.col("base") + F.col("i")).alias("start"), "length")


def covered(spans: Column) -> Column:
    """Number of words inside sorted (start, length) spans, each counted once."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (ids as sorted texts).

    Null and empty texts have no words and no hits; a null item text is no item; a null item_id never
    counts as an item, its words do. Repeated rows get the same result each. Without items nothing is hit.
    """
    found = matches(docs, benchmark)
    by_row = found.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    base = docs.select("doc_id", row_hash(docs["text"]).alias("row"), F.size(item_words(docs["text"])).cast("long").alias("n_words"))
    return join_rows(base, by_row, "left").select(
        "doc_id", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any benchmark window, with the columns they had."""
    # known before texts are dealt out: few rows are hit, and then texts stay where they are
    found = staged(matches(docs, benchmark).select("doc_id", "row").distinct(), "hit")
    drop_shuffles(docs.sparkSession)
    (row,) = fresh(docs, "row")
    keyed = docs.withColumn(row, row_hash(docs["text"]))
    return join_rows(keyed, found.withColumnRenamed("row", row), "left_anti", ("doc_id", row)).drop(row)
