"""Column types by vote over text values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions.text import strip
from unisource.session import spread_small

# ---- fixed values of the vote ----
SAMPLE_ROWS = 100
THRESHOLD = 0.8
BOOLEAN_WORDS = ["true", "false", "1", "0", "oui", "non"]

# Any Unicode digit counts; naming the ASCII ones first lets the matcher use a bit table.
# Possessive quantifiers never back up, so a text is looked at once.
_DIGIT = r"[0-9\p{Nd}]"
_NUMBER = rf"^-?{_DIGIT}++(?:\.{_DIGIT}++)?+\z"
_DATE = rf"^{_DIGIT}{{4}}-{_DIGIT}{{2}}-{_DIGIT}{{2}}"


def _looks_like(value: Column) -> Column:
    """The one pattern a stripped text fits: bit, integer, float, date, word or none.

    No text fits two patterns except 0 and 1, which count as integer and as boolean.
    Cheap byte comparisons come first: a number or a date starts with '-' or a digit,
    hence below ':' in byte order or outside ASCII, and no boolean word has over five bytes.
    """
    numeric_start = (value < ":") | (value >= "\x80")
    return (
        F.when(value.isin("0", "1"), "bit")
        .when(
            numeric_start,
            F.when(value.rlike(_NUMBER), F.when(F.contains(value, F.lit(".")), "float").otherwise("integer"))
            .when(value.rlike(_DATE), "date"),
        )
        .when((F.octet_length(value) <= 5) & F.lower(value).isin(BOOLEAN_WORDS), "word")
    )


def vote(cells: DataFrame, keys: list[str], value: str = "value", merge_numeric: bool = False) -> DataFrame:
    """One type per group of cells, and the counts behind it.

    Only counters are exchanged, a handful per group and task, so a group that holds
    most of the cells costs no more than any other.
    """
    # Most cells need no stripping: a text that fits a pattern as it is fits it stripped too.
    # Each step is a projection of its own, as branches of one CASE would strip again and again.
    raw = cells.select(*keys, F.col(value).alias("_value"), _looks_like(F.col(value)).alias("_raw"))
    bare = raw.select(
        *keys, (F.col("_value") != "").alias("_filled"), "_raw",
        F.when(F.col("_raw").isNull(), strip("_value")).alias("_bare"),
    )
    counted = (
        bare.select(*keys, "_filled", F.coalesce("_raw", _looks_like(F.col("_bare"))).alias("_kind"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_cells"),
            F.count_if("_filled").alias("n_values"),
            F.count_if(F.col("_kind").isin("integer", "bit")).alias("n_integer"),
            F.count_if(F.col("_kind") == "float").alias("n_float"),
            F.count_if(F.col("_kind") == "date").alias("n_date"),
            F.count_if(F.col("_kind").isin("word", "bit")).alias("n_boolean"),
        )
    )

    def wins(count: Column) -> Column:
        return F.try_divide(count.cast("double"), F.col("n_values").cast("double")) > THRESHOLD

    ladder = (
        F.when(wins(F.col("n_date")), "date")
        .when(wins(F.col("n_boolean")), "boolean")
        .when(wins(F.col("n_integer")), "integer")
        .when(wins(F.col("n_float")), "float")
    )
    if merge_numeric:
        ladder = ladder.when(wins(F.col("n_integer") + F.col("n_float")), "float")
    return counted.withColumn("type", ladder.otherwise("string"))


def infer_columns(
    df: DataFrame, sample: int | None = None, order_by: list[str] | None = None,
    merge_numeric: bool = False,
) -> DataFrame:
    """Type of every column of a table of texts.

    Without `sample` the whole table votes. "The first n rows" exist only under an order,
    so a sample needs `order_by` columns that identify a row.
    """
    if sample is not None:
        if not order_by:
            raise ValueError("a sample needs order_by columns that identify a row")
        df = df.orderBy(*order_by).limit(sample)
    else:
        df = spread_small(df)
    names = df.columns
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    cells = texts.unpivot([], texts.columns, "column", "value")
    place = F.substring("column", 2, 10).cast("int")
    labels = F.array(*[F.lit(c) for c in names])
    return vote(cells, ["column"], merge_numeric=merge_numeric).select(
        place.alias("position"),
        strip(F.get(labels, place)).alias("name"),
        "type", "n_cells", "n_values", "n_integer", "n_float", "n_date", "n_boolean",
    )


def table_fields(df: DataFrame, entity: str, **options) -> DataFrame:
    """Inferred columns as field rows of one file entity."""
    return infer_columns(df, **options).select(
        F.lit(entity).alias("entity"), "position", "name", "type", F.lit("csv_column").alias("native_type"),
        F.lit(True).alias("nullable"),
    )
