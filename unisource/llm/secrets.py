"""Secret scans: patterns give the sure finds, ownership across the whole corpus the others.

A long random-looking token without a telling name may be a credential or an example that everyone
copies. Candidates are hashed and counted by distinct owners and distinct repositories over all rows: a
value that one owner has in few repositories looks live and its spans are added; a widely copied
one does not. Spans found by pattern always stay; verdicts() marks by the same counts which spans look copied.
Redaction counts equal texts once and asks for the owners only, so copies of a document hide no live value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.llm.common import fresh, join_rows, row_hash
from unisource.session import staged

KINDS = ("assign", "access", "hex", "owned")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    """A pattern for a word with its letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{24,}"
MIN_VALUE = 6
#: A candidate looks live if so few owners and repositories have it.
MAX_OWNERS = 1
MAX_REPOS = 3

SPAN = "struct<start:int,end:int,kind:int,value:string>"


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches; those with a value under `least` characters are left out.

    Places count code points. They follow from the gaps between the matches, so texts without a match
    are scanned once only.
    """
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else full
    gaps = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(full)).alias("gap"), full.alias("full"), value.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["full"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["full"])).alias("end"),
                F.lit(kind).alias("kind"), x["value"].alias("value"),
            ))).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda s: F.length(s["value"]) >= least),
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, owner: str) -> DataFrame:
    """doc_id, row, owner, base spans and other candidates of every text, written once."""
    text = F.coalesce(docs["text"], F.lit(""))
    read = docs.select(
        "doc_id", row_hash(docs["text"]).alias("row"), docs[owner].cast("string").alias("owner"),
        F.concat(
            found(text, ASSIGN, 0, group=2, least=MIN_VALUE), found(text, ACCESS, 1), found(text, HEX, 2)
        ).alias("base"),
        F.filter(
            found(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        ).alias("more"),
    )
    free = read.withColumn(
        "more",
        F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
    )
    return staged(free.withColumn("base", F.sort_array("base")), "secrets")


def ownership(scanned: DataFrame, once: bool = False) -> DataFrame:
    """Distinct owners and repositories of each candidate value: hash, owners, repos.

    Each step combines before its exchange and the first drops repeats, so a value that a third of
    all documents hold costs one row per task and document at most. A null owner is an owner of its own.
    With `once` all rows of equal text are one repository, of the owner that sorts first.
    """
    values = scanned.select("doc_id", "row", "owner", F.explode(F.concat("base", "more")).alias("s")).select(
        F.xxhash64("s.value").alias("hash"), F.col("owner"), F.col("doc_id"), F.col("row")
    )
    if once:
        values = values.groupBy("hash", "row").agg(F.min("owner").alias("owner")).withColumnRenamed("row", "doc_id")
    else:
        values = values.drop("row")
    repos = values.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return repos.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def looks_live(max_owners: int, max_repos: int | None) -> Column:
    """Whether few enough owners and repositories have a value; None is any number of repositories."""
    few = F.col("owners") <= max_owners
    return few if max_repos is None else few & (F.col("repos") <= max_repos)


def added(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int | None = MAX_REPOS, once: bool = False) -> DataFrame:
    """Live-looking spans by row: doc_id, row, live (sorted spans)."""
    few = ownership(scanned, once).where(looks_live(max_owners, max_repos)).select("hash")
    spans = scanned.select("doc_id", "row", F.explode("more").alias("s")).withColumn("hash", F.xxhash64("s.value"))
    return spans.join(few, "hash").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("s")).alias("live"))


def verdicts(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int | None = None, once: bool = True) -> DataFrame:
    """One row per base span and other candidate: doc_id, row, start, end, kind, owners, repos, looks_live."""
    scanned = scan(docs, owner)
    spans = scanned.select("doc_id", "row", F.explode(F.concat("base", "more")).alias("s")).withColumn("hash", F.xxhash64("s.value"))
    return spans.join(ownership(scanned, once), "hash").select(
        "doc_id", "row", "s.start", "s.end", "s.kind", "owners", "repos", looks_live(max_owners, max_repos).alias("looks_live")
    )


def secret_spans(
    docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int | None = MAX_REPOS, once: bool = False
) -> DataFrame:
    """One row per document row: doc_id, row, base and live, sorted arrays of (start, end, kind, value).

    Null and empty texts have no spans. Rows that repeat an id and its text share their spans and
    count as one repository. An empty table gives no rows.
    """
    scanned = scan(docs, owner)
    live = added(scanned, max_owners, max_repos, once)
    return join_rows(scanned, live, "left").select(
        "doc_id", "row", "base", F.coalesce("live", F.array().cast(f"array<{SPAN}>")).alias("live")
    )


def listed(spans: Column) -> Column:
    """Sorted spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret span replaced by `mark`; overlapping spans become one mark. No row is dropped."""
    names = docs.columns
    row, spans = fresh(docs, "row", "spans")
    found_ = secret_spans(docs, owner, max_repos=None, once=True).where((F.size("base") > 0) | (F.size("live") > 0))
    by_row = found_.select("doc_id", "row", F.sort_array(F.concat("base", "live")).alias("spans")).dropDuplicates(["doc_id", "row"])
    keyed = docs.withColumn(row, row_hash(docs["text"]))
    joined = join_rows(keyed, by_row.toDF("doc_id", row, spans), "left", ("doc_id", row)).drop(row)
    text = joined["text"]
    replaced = F.aggregate(
        joined[spans], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["out"] == "")),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    redacted = F.when(joined[spans].isNull(), text).otherwise(replaced)
    return joined.select(*[redacted.alias(c) if c == "text" else joined[c] for c in names])
