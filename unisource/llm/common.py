"""What the corpus operators share: words, row keys, free column names and staged tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.session import drop_shuffles

# A word is a run of other characters than these.
SPACES = "[\\x20\\x09-\\x0D]+"
# Words of letters, digits and everything beyond ASCII, after lower-casing.
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged (not the locale's rules)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, between: str = SPACES) -> Column:
    """The words of a text in order; an empty array for a null text or one without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`: the split into training and held-out rows.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often and wherever `body` names it.

    A plain column would do only if the optimizer never merged projections: inside a lambda it would
    then be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others can have any name."""
    return docs.select("doc_id", "text", *more)


def row_hash(text: Column) -> Column:
    """With doc_id the key of a row: rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner", on: tuple[str, ...] = ("doc_id", "row")) -> DataFrame:
    """Join on columns that may be null; the result has the key columns of `left` only."""
    names = fresh(left, *[f"right_{c}" for c in on])
    other = right.select(
        *[right[c].alias(n) for c, n in zip(on, names)], *[right[c] for c in right.columns if c not in on]
    )
    cond = F.lit(True)
    for c, n in zip(on, names):
        cond = cond & F.col(c).eqNullSafe(F.col(n))
    return left.join(other, cond, how).drop(*names)


def release(*tables: DataFrame) -> None:
    """Give back the space of staged tables that nothing reads any more: each folder is written again, empty.

    The shuffle files of the jobs so far go with them.
    """
    for table in tables:
        files = table.inputFiles()
        if files:
            empty = table.sparkSession.createDataFrame([], table.schema)
            empty.write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])
    if tables:
        drop_shuffles(tables[0].sparkSession)
