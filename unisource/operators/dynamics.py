"""Dynamics 365: entity definitions, attributes, and the choice between them and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions.text import first_page, page_number
from unisource.functions.types import universal_type
from unisource.operators.edmx import edmx_fields
from unisource.operators.fields import explode_fields, field, settle

_LABEL = "DisplayName:struct<UserLocalizedLabel:struct<Label:string>>"
_DEFINITIONS = (
    "value array<struct<LogicalName:string,PrimaryIdAttribute:string,PrimaryNameAttribute:string,"
    f"IsCustomEntity:boolean,IsIntersect:boolean,{_LABEL}>>"
)
_ATTRIBUTES = (
    "value array<struct<LogicalName:string,AttributeType:string,IsPrimaryId:boolean,"
    f"RequiredLevel:struct<Value:string>,{_LABEL}>>"
)


def _label(row: Column, default: Column) -> Column:
    return F.coalesce(row["DisplayName"]["UserLocalizedLabel"]["Label"], default)


def primary_fields(d: Column) -> Column:
    """The pair of fields every definition names: its id and its name column."""
    return F.array(
        field(F.coalesce(d["PrimaryIdAttribute"], F.lit("id")), F.lit("uuid"), F.lit("Edm.Guid"), False, True),
        field(F.coalesce(d["PrimaryNameAttribute"], F.lit("name")), F.lit("string"), F.lit("Edm.String")),
    )


def definition_rows(body: Column | str) -> Column:
    """Entity definitions of a reply without intersect tables."""
    return F.filter(F.from_json(body, _DEFINITIONS)["value"], lambda d: ~F.coalesce(d["IsIntersect"], F.lit(False)))


def definition_name(d: Column) -> Column:
    return F.coalesce(d["LogicalName"], F.lit(""))


def definition_label(d: Column) -> Column:
    custom = F.when(F.coalesce(d["IsCustomEntity"], F.lit(False)), " (Custom)").otherwise(" (Standard)")
    return F.concat(_label(d, definition_name(d)), custom)


def attribute_rows(body: Column | str) -> Column:
    """Fields of one reply with attributes."""

    def describe(a: Column) -> Column:
        name = F.coalesce(a["LogicalName"], F.lit(""))
        native = F.coalesce(a["AttributeType"], F.lit("String"))
        return field(
            name, universal_type(native, "dynamics"), native,
            nullable=F.coalesce(a["RequiredLevel"]["Value"], F.lit("None")) == "None",
            primary_key=F.coalesce(a["IsPrimaryId"], F.lit(False)),
            foreign_key=F.lower(native) == "lookup",
            description=_label(a, name),
        )

    return F.transform(F.from_json(body, _ATTRIBUTES)["value"], describe)


def definitions(landed: DataFrame, top: int | None = None) -> DataFrame:
    """Entity definitions without intersect tables, all or the first `top` of each reply."""
    rows = definition_rows("body")
    if top is not None:
        rows = F.slice(rows, 1, top)
    return (
        landed.filter(F.coalesce("status", F.lit(200)) < 400)
        .select("source_id", "path", F.posexplode(rows).alias("entity_no", "_d"))
        .select(
            "source_id", "path", "entity_no", definition_name(F.col("_d")).alias("entity"),
            F.lit("dynamics_entity").alias("entity_type"),
            definition_label(F.col("_d")).alias("entity_description"),
            primary_fields(F.col("_d")).alias("fields"),
        )
    )


def definition_fields(landed: DataFrame, top: int | None = None) -> DataFrame:
    """Id and name field of every definition."""
    return explode_fields(definitions(landed, top), keep_empty=False)


def attribute_fields(
    landed: DataFrame, attributes: DataFrame, top: int | None = None,
    top_attributes: int | None = None,
) -> DataFrame:
    """All attributes of every definition (`entity_hint` of a reply names its entity).

    The pages of an entity's attributes are put together in page order, by the keys the join needs anyway, and
    unfolded after it, so one row per page is exchanged. `top_attributes` counts over all pages. An entity
    without attributes keeps its id and name field.
    """
    described = attributes.filter((F.coalesce("status", F.lit(200)) < 400) & F.col("entity_hint").isNotNull()).select(
        "source_id", F.col("entity_hint").alias("entity"), "path", attribute_rows("body").alias("_own")
    )
    pages = settle(described, "_own").filter(F.size("_own") > 0)
    page = F.struct(first_page("path").alias("at"), page_number("path").alias("page"), F.col("_own").alias("own"))
    own = F.flatten(F.transform(F.sort_array(F.collect_list(page)), lambda p: p["own"]))
    replies = pages.groupBy("source_id", "entity").agg((own if top_attributes is None else F.slice(own, 1, top_attributes)).alias("_own"))
    joined = definitions(landed, top).join(replies, ["source_id", "entity"], "left")
    return explode_fields(
        joined.withColumn("fields", F.coalesce("_own", "fields")), keep_empty=False
    )


def choose_metadata(from_definitions: DataFrame, landed_edmx: DataFrame) -> DataFrame:
    """Definitions where a source has any, its metadata document otherwise."""
    covered = from_definitions.select("source_id").distinct()
    rest = landed_edmx.join(covered, "source_id", "left_anti")
    return from_definitions.unionByName(edmx_fields(rest, "dynamics"))
