"""Queries of the operators that count tokens, learn models or pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.llm import jaccard, language, lm, packing, periodic, phrases, simhash, substrings, tokens, toxicity
from unisource.llm.common import remainder, words
from unisource.llm.queries.native import read

TOKEN_LIMIT = 4096
TOXIC_FROM = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(docs["doc_id"], 4) == 2
    model = toxicity.fit(docs.where(~held_out), read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id", held_out.alias("held_out")])
    return scored.withColumn("predicted", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(docs["doc_id"], 5) == 0
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model, ["doc_id", held_out.alias("held_out")])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by add-one unigrams and by deleted interpolation."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    left = remainder(docs["doc_id"], 7)
    return lm.lm_scores(docs, train=left != 2, held_out=left == 2, deleted=left == 3)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated sequences of 35 words."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(docs, 4, 85, 100).drop("row")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which repeat part of their words as the contract says."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    tail = F.transform(
        F.sequence(F.col("_a"), n - 1), lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    )
    dealt = (
        docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words(docs["text"])))
        .withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.floor((n - F.col("_a")) / (F.lit(3) + g % 8)) + 1)
        .withColumn("text", F.when(n > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")).otherwise(F.col("text")))
    )
    found = periodic.periodic_runs(dealt.select("doc_id", "text"))
    run = "struct<start:bigint,period:bigint,length:bigint>"

    def longer(best, r):
        """Of two exact exponents the greater; of equal ones the first, since runs are in order."""
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", F.lit(None).cast(run), longer)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return phrases.collocations(read(spark, sf_dir, "documents").select("lang", "text"), 30, 2000)


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in two bits or fewer."""
    return simhash.near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"), 3, 2).drop("row")
