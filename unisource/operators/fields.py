"""The common shape of discovered fields, and its way into catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions.text import display_name
from unisource.schemas import DISCOVERED_COLUMNS

ENTITY_KEY = ["source_id", "path", "entity_no", "entity"]


def field(
    name: Column, type: Column, native_type: Column, nullable: Column | bool = True,
    primary_key: Column | bool = False, foreign_key: Column | bool = False,
    description: Column | str = "",
) -> Column:
    """One field descriptor."""
    return F.struct(
        name.cast("string").alias("name"),
        type.cast("string").alias("type"),
        native_type.cast("string").alias("native_type"),
        F.lit(nullable).alias("nullable"),
        F.lit(primary_key).alias("primary_key"),
        F.lit(foreign_key).alias("foreign_key"),
        F.lit(description).cast("string").alias("description"),
    )


FIELDS = (
    "array<struct<name:string,type:string,native_type:string,nullable:boolean,"
    "primary_key:boolean,foreign_key:boolean,description:string>>"
)
RELATIONS = "array<struct<source_field:string,target_entity:string,target_field:string,relation_type:string>>"


def relation(source_field: Column, target_entity: Column, target_field: Column, relation_type: Column) -> Column:
    """One relation of an entity."""
    return F.struct(
        source_field.alias("source_field"), target_entity.alias("target_entity"), target_field.alias("target_field"),
        relation_type.alias("relation_type"),
    )


def fixed_field(name: str, type: str, native_type: str, nullable: bool, primary_key: bool) -> Column:
    return field(F.lit(name), F.lit(type), F.lit(native_type), nullable, primary_key)


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Keep parsed columns parsed once: a later filter on them is not pushed below, where
    the optimizer would have to repeat the parsing expression. Unfolding a one-element
    array changes no row and is a step filters do not cross."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def explode_fields(entities: DataFrame, keep_empty: bool) -> DataFrame:
    """Unfold a `fields` array; an entity without fields stays as one null-position row or goes."""
    unfolded = entities.select("*", F.posexplode_outer("fields").alias("position", "_field"))
    if not keep_empty:
        # after the unfolding: a size filter before it would build every array twice
        unfolded = unfolded.filter(F.col("position").isNotNull())
    return unfolded.select("*", "_field.*").select(*DISCOVERED_COLUMNS)


def entity_id() -> Column:
    """Stable id, so a retried task writes the same row again."""
    return F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ENTITY_KEY]))


def dedup_fields(fields: DataFrame, keys: list[str], order: str, attributes: list[str]) -> DataFrame:
    """Same name saved twice: the place of the first, the attributes of the last.

    Both are aggregates, so repeated names shrink on the map side before the one exchange.
    """
    last = F.max_by(F.struct(*attributes), order)
    return (
        fields.groupBy(*keys)
        .agg(F.min(order).alias(order), last.alias("_last"))
        .select(*keys, order, *[F.col(f"_last.{a}").alias(a) for a in attributes])
    )


def to_entities(discovered: DataFrame) -> DataFrame:
    """Catalog rows of the entities found."""
    headers = discovered.select(*ENTITY_KEY, "entity_type", "entity_description").distinct()
    return headers.select(
        entity_id().alias("id"),
        "source_id",
        F.col("entity").alias("name"),
        display_name("entity").alias("display_name"),
        F.coalesce("entity_type", F.lit("table")).alias("entity_type"),
        F.col("entity_description").alias("description"),
        F.lit(None).cast("bigint").alias("row_count"),
        F.lit(True).alias("is_visible"),
        F.current_timestamp().alias("created_at"),
    )


def to_fields(discovered: DataFrame) -> DataFrame:
    """Catalog rows of the fields found, one per entity and name."""
    found = discovered.filter(F.col("position").isNotNull()).withColumn("entity_id", entity_id())
    merged = dedup_fields(
        found, ["source_id", "entity_id", "name"], "position",
        ["type", "native_type", "nullable", "primary_key", "foreign_key"],
    )
    return merged.select(
        F.md5(F.concat_ws("\x1f", "entity_id", "name")).alias("id"),
        "entity_id",
        "source_id",
        "name",
        display_name("name").alias("display_name"),
        F.coalesce("type", F.lit("string")).alias("data_type"),
        "native_type",
        F.coalesce("nullable", F.lit(True)).alias("is_nullable"),
        F.coalesce("primary_key", F.lit(False)).alias("is_primary_key"),
        F.coalesce("foreign_key", F.lit(False)).alias("is_foreign_key"),
        "position",
    )


def sync_summary(discovered: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Entities, fields and relations found per source, fields counted before merging repeated names."""
    keyed = discovered.withColumn("_entity", F.struct(*ENTITY_KEY))
    counted = keyed.groupBy("source_id", "_entity").agg(F.count("position").alias("n"))
    totals = counted.groupBy("source_id").agg(F.count("*").alias("entity_count"), F.sum("n").alias("field_count"))
    if relations is None:
        related = totals.withColumn("relation_count", F.lit(0).cast("bigint"))
    else:
        per_source = relations.groupBy("source_id").agg(F.count("*").alias("relation_count"))
        related = totals.join(per_source, "source_id", "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))
    return (
        related
        .withColumn(
            "message",
            F.format_string("%d entites, %d champs synchronises", "entity_count", "field_count"),
        )
    )
