"""CSV and JSON files, uploads and their previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.text import strip
from unisource.operators.infer import infer_columns
from unisource.schemas import DISCOVERED_COLUMNS
from unisource.session import staged
from unisource.sources import csv_records

# ---- fixed values: rows of an upload preview, file types accepted ----
PREVIEW_ROWS = 5
UPLOAD_EXTENSIONS = [".csv", ".json", ".txt"]

def _csv_options(multi_line: bool, encoding: str) -> dict:
    # a quote inside quotes is doubled; a backslash is an ordinary character
    return {
        "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "maxColumns": 1_000_000, "encoding": encoding,
    }


def file_flags(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: spans (a record spans lines, or a line holds blanks only), broken (bytes that are no UTF-8), header.

    One scan and one aggregation, of which a task sends a row per file. The header is a file's first line
    without byte order mark, quotes and outer blanks.
    """
    line = F.col("line")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    blank = (line != "") & (F.trim(line) == "")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.col("value").alias("line"),
    )
    return lines.groupBy("file").agg(
        F.bool_or((quotes % 2 == 1) | blank | ~F.is_valid_utf8("line")).alias("spans"), F.bool_or(~F.is_valid_utf8("line")).alias("broken"),
        strip(F.translate(F.min_by("line", F.struct("block", "no")), "\ufeff\"", "")).alias("header"),
    )


class CsvTable:
    """CSV files as texts: `names` as in the header, columns c0, c1, ... in `data`, in any order; `ordered` streams in file order."""

    def __init__(self, data: DataFrame, names: list[str], ordered: DataFrame | None = None):
        self.data = data
        self.names = names
        self.ordered = data if ordered is None else ordered

    def rows(self) -> DataFrame:
        """Rows under stripped header names; of equal names the last column counts."""
        last = {name: i for i, name in enumerate(self.names)}
        return self.data.select(*[F.col(f"c{i}").alias(name.strip()) for name, i in last.items()])


def read_csv(
    spark: SparkSession, path: str, multi_line: bool | None = None, encoding: str = "UTF-8"
) -> CsvTable:
    """Read CSV files with a header row: blank lines skipped, short rows filled with
    nulls, extra cells dropped, byte order mark removed.

    `multi_line` tells whether records span lines: True reads each file as one stream, False cuts files at any line
    end. None looks: files with such records go through `csv_records`, many tasks each, all others are cut at
    line ends. UTF-8 that is none, and files with another header than the others, are refused then.
    """
    header = spark.read.options(**_csv_options(True, encoding)).csv(path, header=False).limit(1).first()
    names = ["" if h is None else h for h in header] if header else []
    if not names:
        return CsvTable(spark.createDataFrame([], "c0 string").select(), [])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))

    def read(whole: bool) -> DataFrame:
        return spark.read.options(**_csv_options(whole, encoding)).schema(schema).csv(path, header=True)

    if multi_line is not None:
        return CsvTable(read(multi_line), names)
    flags = staged(file_flags(spark, path), "csv-files")
    seen = flags.agg(
        F.min(F.when(F.col("broken"), F.col("file"))).alias("broken"), F.min("header").alias("low"), F.max("header").alias("high"),
        F.bool_or("spans").alias("some"), F.bool_and("spans").alias("all"),
    ).first()
    if seen["broken"] is not None and encoding == "UTF-8":
        raise ValueError(f"not valid UTF-8: {seen['broken']}")
    if seen["low"] != seen["high"]:
        raise ValueError(f"files with different headers: {seen['low']!r} and {seen['high']!r}")
    if not seen["some"]:
        return CsvTable(read(False), names)
    spanning = flags.filter("spans").select("file")
    lines = csv_records.file_lines(spark, path, encoding).join(spanning, "file", "left_semi")
    options = {k: str(v) for k, v in _csv_options(True, encoding).items() if k in ("escape", "maxColumns")}
    data = csv_records.data_rows(spark, lines, schema, options)
    if not seen["all"]:
        others = read(False).select("*", F.col("_metadata.file_path").alias("file")).join(spanning, "file", "left_anti").drop("file")
        data = data.unionByName(others)
    return CsvTable(data, names, read(True))


def csv_fields(
    spark: SparkSession, path: str, entity: str, source_id: str = "", sample: int | None = None,
    multi_line: bool | None = None, merge_numeric: bool = False,
) -> DataFrame:
    """Entity of one CSV file. All rows vote, or the first `sample` in file order (`infer.SAMPLE_ROWS` is what a quick look takes).

    A file without data rows has no fields, even if it has a header.
    """
    table = read_csv(spark, path, multi_line)
    last = {name: i for i, name in enumerate(table.names)}
    # equal names all show the last column's values, as a row keyed by name does
    shown = [F.col(f"c{last[n]}").alias(f"c{i}") for i, n in enumerate(table.names)]
    texts = table.data.select(*shown)
    if not table.names:
        typed = spark.createDataFrame([], "position int, type string, n_rows bigint")
    elif sample is None:
        # every column has one cell a row, so the vote has counted the rows too
        typed = infer_columns(texts, merge_numeric=merge_numeric).select(
            "position", "type", F.col("n_cells").alias("n_rows")
        )
    else:
        # `sample` rows at most; take() reads the file's first partitions in order and stops
        first = spark.createDataFrame(table.ordered.select(*shown).take(sample), texts.schema)
        typed = infer_columns(first, merge_numeric=merge_numeric).select(
            "position", "type", table.data.agg(F.count("*")).scalar().alias("n_rows")
        )
    labels = F.array(*[F.lit(n) for n in table.names or [""]])
    columns = typed.select(
        F.lit(path).alias("path"), "position", strip(F.get(labels, F.col("position"))).alias("name"), "type",
        F.lit("csv_column").alias("native_type"), F.lit(True).alias("nullable"),
        F.lit(False).alias("primary_key"), F.lit(False).alias("foreign_key"), F.lit("").alias("description"),
        F.format_string(f"CSV - %d lignes, {len(table.names)} colonnes", "n_rows").alias("entity_description"),
    )
    # a file without rows gives no votes: the row of its entity alone stays
    entity_row = spark.createDataFrame(
        [(source_id, path, 0, entity, "file")],
        "source_id string, path string, entity_no int, entity string, entity_type string",
    )
    return entity_row.join(columns, "path", "left").select(*DISCOVERED_COLUMNS)


def land_files(
    spark: SparkSession, path: str, source_id: str, entity: str, dialect: str = "file_json"
) -> DataFrame:
    """Whole text files as landed payloads, one row each."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(source_id).alias("source_id"),
        F.lit(dialect).alias("dialect"),
        F.lit(entity).alias("entity_hint"),
        F.col("_metadata.file_path").alias("path"),
        F.lit(200).alias("status"),
        F.regexp_replace("value", "^﻿", "").alias("body"),
    )


def land_lines(
    spark: SparkSession, path: str, source_id: str, entity: str, dialect: str = "file_json"
) -> DataFrame:
    """Files of one JSON document per line, which may be split anywhere; blank lines are skipped."""
    return spark.read.text(path).filter(strip("value") != "").select(
        F.lit(source_id).alias("source_id"),
        F.lit(dialect).alias("dialect"),
        F.lit(entity).alias("entity_hint"),
        F.col("_metadata.file_path").alias("path"),
        F.lit(200).alias("status"),
        F.col("value").alias("body"),
    )


def file_format(spark: SparkSession, path: str, connector_type: str) -> str:
    """csv or json: by connector type, else by the first character that is no blank."""
    if connector_type == "file_csv":
        return "csv"
    if connector_type == "file_json":
        return "json"
    text = strip(F.regexp_replace("value", "^﻿", ""))
    first = (
        spark.read.text(path).filter(text != "").select(F.substring(text, 1, 1).alias("c")).first()
    )
    return "json" if first and first["c"] in "{[" else "csv"


def decode_preview(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no valid UTF-8; a byte order mark stays."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def decode_sync(content: Column) -> Column:
    """UTF-8 without its byte order mark; invalid bytes fail the query."""
    return F.regexp_replace(F.validate_utf8(content.cast("string")), "^﻿", "")


def preview_head(df: DataFrame, order_by: list[str] | None = None, n: int = PREVIEW_ROWS) -> DataFrame:
    """First rows: in file order, or by columns that identify a row."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def preview_json(landed: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First items of a root list, or the object itself; columns are the first item's keys."""
    parsed = landed.select(
        "path", "body", J.items("body").alias("_items"), J.entries("body").alias("_pairs")
    )
    sample = F.when(F.col("_items").isNotNull(), J.entries(F.get(J.item_texts("body"), 0))).otherwise(F.col("_pairs"))
    columns = F.coalesce(F.transform(sample, lambda e: e["key"]), F.array().cast("array<string>"))
    preview = F.coalesce(F.slice("_items", 1, n), F.array(F.try_parse_json("body")))
    return parsed.select("path", columns.alias("columns"), preview.alias("preview")).withColumn(
        "column_count", F.size("columns")
    )


def preview_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What an upload holds: one row about the file, and its first rows or items.

    .csv and .txt are read as CSV, .json as JSON; a file that is no UTF-8 is read as Latin-1.
    """
    extension = path[path.rfind("."):].lower()
    if extension not in UPLOAD_EXTENSIONS:
        raise ValueError(f"unsupported file type {extension}, accepted: {', '.join(UPLOAD_EXTENSIONS)}")
    if extension == ".json":
        content = spark.read.format("binaryFile").load(path).select("path", decode_preview(F.col("content")).alias("body"))
        parsed = preview_json(content)
        preview = parsed.select(F.explode("preview").alias("row"))
        columns = parsed.select("columns")
    else:
        valid = spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()
        # one stream, of which the first rows are read
        preview = preview_head(read_csv(spark, path, True, "UTF-8" if valid else "ISO-8859-1").rows())
        shown = F.array(*[F.lit(c) for c in preview.columns]) if preview.columns else F.array().cast("array<string>")
        columns = preview.agg(F.when(F.count("*") > 0, shown).otherwise(F.array().cast("array<string>")).alias("columns"))
    about = list_uploads(spark, path).select(
        "filename", "path", "size", F.lit("json" if extension == ".json" else "csv").alias("format"),
        columns.scalar().alias("columns"),
    ).withColumn("column_count", F.size("columns"))
    return about, preview


def list_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their sizes; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("size")
    )
