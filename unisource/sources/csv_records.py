"""CSV records that span lines, found by many tasks in one file.

A file is read as lines, by as many tasks as it has splits. Whether a line begins inside a quoted cell depends on all
lines before it. But there are only two cases, so a line is a map from the case before it to the case behind it: it leaves
the case as it is, turns it around, or ends in one case whatever came before. Such maps compose by running sums,
first within each split, then over the few splits of a file; with the case at its beginning known, every split knows
where its records start. Only records across a border of splits meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unisource.session import staged

QUOTE = '"'
# Where a scan of a line stands at a quote: outside, inside a quoted cell, behind a quote that may have closed one.
OUTSIDE, INSIDE, CLOSING = 0, 1, 2


def ends_inside(line: Column, begins_inside: bool) -> Column:
    """Whether a line ends inside a quoted cell.

    A quote opens a cell only at its beginning, two quotes inside stand for one, and any other quote is a character.
    """
    pieces = F.split(line, QUOTE, -1)
    begin = INSIDE if begins_inside else OUTSIDE

    def step(at: Column, piece: Column) -> Column:
        # `piece` lies before the quote, `first` marks the one at the line's beginning
        opens = piece["text"].endswith(",") | (piece["first"] & (piece["text"] == "") & (not begins_inside))
        return (
            F.when(at == INSIDE, CLOSING)
            .when((at == CLOSING) & (piece["text"] == ""), INSIDE)
            .when(opens, INSIDE).otherwise(OUTSIDE)
        )

    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(p.alias("text"), (i == 0).alias("first")))
    return F.aggregate(before, F.lit(begin), step) == INSIDE


def file_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, block (where its split begins), no (order within a split) and line; a line's end is LF, a CR before it stays."""
    read = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.col("value").alias("line"),
    )


def line_maps(lines: DataFrame) -> DataFrame:
    """Lines with `fixed` (the case they end in whatever came before, or null) and `turns` (whether they turn it around)."""
    plain = ~F.contains("line", F.lit(QUOTE))
    both = F.when(plain, F.struct(F.lit(False).alias("a"), F.lit(True).alias("b"))).otherwise(
        F.struct(ends_inside(F.col("line"), False).alias("a"), ends_inside(F.col("line"), True).alias("b"))
    )
    mapped = lines.select("*", F.inline(F.array(both)))
    return mapped.select("file", "block", "no", "line", F.when(F.col("a") == F.col("b"), F.col("a")).alias("fixed"), (F.col("a") & ~F.col("b")).alias("turns"))


def _running(mapped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`set`: the last line at or before each that fixes the case, with the turns up to it; `turned`: turns so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = mapped.withColumn("turned", F.sum(F.col("turns").cast("long")).over(w))
    last = F.struct(*order, F.col("fixed").alias("fixed"), F.col("turned").alias("upto"))
    return counted.withColumn("set", F.max(F.when(F.col("fixed").isNotNull(), last)).over(w))


def _case(begin: Column) -> Column:
    """The case behind a row of `_running`, from the one at the beginning."""
    turns = F.col("turned") - F.coalesce("set.upto", F.lit(0))
    return F.coalesce("set.fixed", begin) != (turns % 2 == 1)


def records(lines: DataFrame) -> DataFrame:
    """file, block, no and record of every record of every file, line ends within as they were, the one behind gone.

    `block` and `no` are the place of a record's first line. Every quoted cell that a file leaves open ends with it. A
    quote that opens and never closes makes the rest of its file one record, as it does for any reader.
    """
    run = _running(line_maps(lines), ["file", "block"], ["no"])
    # the whole map of each split, and from those the case at the beginning of each
    splits = run.groupBy("file", "block").agg(F.max(F.struct("no", "turned", "set")).alias("end")).select(
        "file", "block", F.col("end.set.fixed").alias("fixed"), (F.col("end.turned") - F.coalesce("end.set.upto", F.lit(0))).alias("turns")
    )
    whole = F.col("turns") % 2 == 1
    composed = splits.select("file", "block", F.when(F.col("fixed").isNotNull(), F.col("fixed") != whole).alias("fixed"), (F.col("fixed").isNull() & whole).alias("turns"))
    behind = _running(composed, ["file"], ["block"]).withColumn("behind", _case(F.lit(False)))
    previous = Window.partitionBy("file").orderBy("block")
    begins = staged(behind.select("file", "block", F.coalesce(F.lag("behind").over(previous), F.lit(False)).alias("begins")), "splits")

    order = Window.partitionBy("file", "block").orderBy("no")
    known = run.join(begins, ["file", "block"]).withColumn("_behind", _case(F.col("begins")))
    opened = known.withColumn("starts", ~F.coalesce(F.lag("_behind").over(order), F.col("begins")))
    numbered = opened.withColumn("part", F.sum(F.col("starts").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    parts = staged(
        numbered.groupBy("file", "block", "part").agg(
            text.alias("text"), F.min("no").alias("no"), F.max(F.struct("no", "_behind")).alias("end")
        ).select("file", "block", "part", "text", "no", F.col("end._behind").alias("open")), "records",
    )
    # part 0 goes on with a record of an earlier split; a split's last part may be left open
    closed = parts.filter((F.col("part") > 0) & ~F.col("open")).select("file", "block", "no", F.col("text").alias("record"))
    torn = parts.filter((F.col("part") == 0) | F.col("open"))
    upto = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    owned = torn.withColumn("owner", F.max(F.when(F.col("part") > 0, F.struct("block", "no"))).over(upto))
    glued = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), "\n")
    joined = owned.groupBy("file", "owner").agg(glued.alias("record")).select("file", "owner.block", "owner.no", "record")
    return closed.unionAll(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def data_rows(spark: SparkSession, lines: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    """Cells of all records but each file's first, its header; empty lines are none."""
    found = records(lines).filter(F.col("record") != "")
    header = found.groupBy("file").agg(F.min(F.struct("block", "no")).alias("header"))
    rest = found.join(header, "file").filter(F.struct("block", "no") != F.col("header"))
    return rest.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
