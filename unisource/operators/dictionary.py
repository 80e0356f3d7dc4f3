"""Fields out of a database's dictionary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions.text import starts_with_any
from unisource.functions.types import universal_type
from unisource.operators.fields import field, relation
from unisource.operators.sage import SAGE_100_PREFIXES
from unisource.schemas import DISCOVERED_COLUMNS

_COLUMN = ["source_id", "table_name", "column_name"]


def dictionary_fields(
    columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, variant: str = "live",
    entity_type: str = "table",
) -> DataFrame:
    """Columns with their key flags; membership in a constraint sets the flag.

    Both joins use the same full column key, so the columns are exchanged once and a table
    with very many columns spreads over all tasks.
    """
    pk = primary_keys.select(*_COLUMN).distinct().withColumn("_pk", F.lit(True))
    fk = (
        foreign_keys.select("source_id", "table_name", F.explode("constrained").alias("column_name"))
        .distinct()
        .withColumn("_fk", F.lit(True))
    )
    described = (
        F.concat(F.lit("Table SAGE 100 "), "table_name") if entity_type == "sage100_table"
        else F.lit(None).cast("string")
    )
    return (
        columns.join(pk, _COLUMN, "left")
        .join(fk, _COLUMN, "left")
        .select(
            "source_id",
            F.lit("").alias("path"),
            F.lit(0).alias("entity_no"),
            F.col("table_name").alias("entity"),
            F.lit(entity_type).alias("entity_type"),
            described.alias("entity_description"),
            F.col("position").cast("int").alias("position"),
            F.col("column_name").alias("name"),
            universal_type("native_type", "sql", variant).alias("type"),
            "native_type",
            F.coalesce("nullable", F.lit(True)).alias("nullable"),
            F.coalesce("_pk", F.lit(False)).alias("primary_key"),
            F.coalesce("_fk", F.lit(False)).alias("foreign_key"),
            F.lit("").alias("description"),
        )
        .select(*DISCOVERED_COLUMNS)
    )


# One table of a dictionary as a payload.
TABLE = (
    "columns array<struct<position:int,name:string,native_type:string,nullable:boolean>>, primary_key array<string>, "
    "foreign_keys array<struct<constrained:array<string>,referred_table:string,referred:array<string>>>"
)


def land_dictionary(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, dialect: str = "sql") -> DataFrame:
    """Dictionary rows as payloads, one per table with columns; the three inputs meet in one aggregation.

    Dialects: `sql`, or `sage_100` for that database's prefixes and type names.
    """
    parts = {
        "c": "struct<position:int,name:string,native_type:string,nullable:boolean>", "p": "string",
        "f": "struct<constrained:array<string>,referred_table:string,referred:array<string>>",
    }

    def part(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select("source_id", "table_name", *[(value if n == name else F.lit(None)).cast(t).alias(n) for n, t in parts.items()])

    rows = (
        part(columns, "c", F.struct("position", "column_name", "native_type", "nullable"))
        .unionAll(part(primary_keys, "p", F.col("column_name")))
        .unionAll(part(foreign_keys, "f", F.struct("constrained", "referred_table", "referred")))
    )
    tables = rows.groupBy("source_id", "table_name").agg(
        F.sort_array(F.collect_list("c")).alias("columns"), F.sort_array(F.collect_set("p")).alias("primary_key"), F.sort_array(F.collect_list("f")).alias("foreign_keys")
    )
    return tables.filter(F.size("columns") > 0).select(
        "source_id", F.lit(dialect).alias("dialect"), F.col("table_name").alias("entity_hint"), F.lit("").alias("path"), F.lit(200).alias("status"),
        F.to_json(F.struct("columns", "primary_key", "foreign_keys")).alias("body"),
    )


def table_fields(table: Column, variant: str) -> Column:
    """Fields of a landed table."""
    foreign = F.flatten(F.transform(table["foreign_keys"], lambda f: f["constrained"]))

    def describe(c: Column) -> Column:
        return field(
            c["name"], universal_type(c["native_type"], "sql", variant), c["native_type"], F.coalesce(c["nullable"], F.lit(True)),
            F.coalesce(F.array_contains(table["primary_key"], c["name"]), F.lit(False)), F.coalesce(F.array_contains(foreign, c["name"]), F.lit(False)),
        )

    return F.transform(table["columns"], describe)


def table_relations(table: Column) -> Column:
    """Foreign keys of a landed table, column by column up to the shorter of the two lists."""

    def pairs(f: Column) -> Column:
        both = F.filter(F.arrays_zip(f["constrained"].alias("c"), f["referred"].alias("r")), lambda p: p["c"].isNotNull() & p["r"].isNotNull())
        return F.transform(both, lambda p: relation(p["c"], f["referred_table"], p["r"], F.lit("many_to_one")))

    return F.flatten(F.transform(table["foreign_keys"], pairs))


def prefix_filter(tables: DataFrame, prefixes: list[str] | None = None, name: str = "table_name") -> DataFrame:
    """Tables whose name starts with one of the prefixes, upper or lower case."""
    return tables.filter(starts_with_any(name, SAGE_100_PREFIXES if prefixes is None else prefixes))


def sage_100_fields(
    columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, prefixes: list[str] | None = None
) -> DataFrame:
    """Dictionary of a SAGE 100 database: its own prefixes and type names."""
    return dictionary_fields(
        prefix_filter(columns, prefixes), primary_keys, foreign_keys, "sage100", "sage100_table"
    )
