"""Entity types, keys, properties and navigation properties of OData metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unisource.functions.text import col
from unisource.functions.types import universal_type
from unisource.operators.fields import FIELDS, explode_fields, field, relation

_ENTITY_TYPE = (
    "array<struct<_Name:string,_Abstract:string,"
    "Key:struct<PropertyRef:array<struct<_Name:string>>>,"
    "Property:array<struct<_Name:string,_Type:string,_Nullable:string,_label:string,"
    "Annotation:array<struct<_Term:string,_String:string>>>>,"
    "NavigationProperty:array<struct<_Name:string,_Type:string,_ToRole:string>>>>"
)
# Arrays everywhere, so one element and many read alike.
_EDMX = f"DataServices array<struct<Schema:array<struct<EntityType:{_ENTITY_TYPE}>>>>, Schema array<struct<EntityType:{_ENTITY_TYPE}>>, EntityType {_ENTITY_TYPE}"

# ---- fixed values: variant -> type map and entity type ----
VARIANTS = {
    "odata": ("live", "odata_entity"),
    "odata_lib": ("lib", "odata_entity"),
    "sap": ("live", "sap_odata_entity"),
    "dynamics": ("live", "dynamics_entity"),
    "dynamics_lib": ("dynamics", "dynamics_entity"),
    "sap_lib": ("sap", "sap_odata_entity"),
}


def _all_types(doc: Column) -> Column:
    """Entity types of every schema, wherever the document's root starts."""
    schemas = F.coalesce(
        F.flatten(F.filter(F.transform(doc["DataServices"], lambda d: d["Schema"]), lambda s: s.isNotNull())),
        doc["Schema"],
    )
    nested = F.flatten(F.filter(F.transform(schemas, lambda s: s["EntityType"]), lambda e: e.isNotNull()))
    return F.coalesce(nested, doc["EntityType"])


def entity_types(landed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity type of each metadata document; unreadable XML and refused requests give none."""
    doc = F.from_xml("body", _EDMX, {"ignoreNamespace": "true"})
    carried = ["source_id", "path", "entity_hint", *keep]
    if "status" in landed.columns:
        landed = landed.filter(F.coalesce("status", F.lit(200)) < 400)
    return (
        landed.select(*carried, doc.alias("_doc"))
        .select(*carried, F.posexplode(_all_types(F.col("_doc"))).alias("entity_no", "_t"))
        .select(
            *carried, "entity_no",
            F.coalesce("_t._Name", F.lit("Unknown")).alias("entity"),
            is_abstract(F.col("_t")).alias("is_abstract"),
            type_keys(F.col("_t")).alias("keys"),
            F.col("_t.Property").alias("properties"),
            F.col("_t.NavigationProperty").alias("navigations"),
        )
    )


def type_fields(properties: Column, navigations: Column, keys: Column, variant: str) -> Column:
    """Fields of one entity type: properties first, then navigation properties."""
    types, _ = VARIANTS[variant]

    def describe(p: Column) -> Column:
        if variant.startswith("sap"):
            return F.coalesce(p["_label"], F.lit(""))
        if variant == "dynamics_lib":
            labels = F.filter(p["Annotation"], lambda a: F.coalesce(a["_Term"], F.lit("")).endswith("DisplayName"))
            return F.coalesce(F.try_element_at(labels, F.lit(-1))["_String"], F.lit(""))
        return F.lit("")

    def from_property(p: Column) -> Column:
        native = F.coalesce(p["_Type"], F.lit("Edm.String"))
        name = F.coalesce(p["_Name"], F.lit(""))
        stated = F.lower(F.coalesce(p["_Nullable"], F.lit("true")))
        return field(
            name, universal_type(native, "edm", types), native,
            nullable=(stated == "true") if variant == "odata_lib" else (stated != "false"),
            primary_key=F.array_contains(keys, name),
            description=describe(p),
        )

    def from_navigation(n: Column) -> Column:
        other = n["_ToRole"] if variant.startswith("odata") else F.lit(None)
        native = F.coalesce(n["_Type"], other, F.lit(""))
        return field(F.coalesce(n["_Name"], F.lit("")), F.lit("relation"), native, foreign_key=True)

    empty = F.array().cast(FIELDS)
    return F.concat(
        F.coalesce(F.transform(properties, from_property), empty),
        F.coalesce(F.transform(navigations, from_navigation), empty),
    )


def type_keys(entity_type: Column) -> Column:
    """Names of the key columns, in key order."""
    names = F.transform(entity_type["Key"]["PropertyRef"], lambda r: F.coalesce(r["_Name"], F.lit("")))
    return F.coalesce(names, F.array().cast("array<string>"))


def is_abstract(entity_type: Column) -> Column:
    return F.lower(F.coalesce(entity_type["_Abstract"], F.lit("false"))) == "true"


def navigation(n: Column) -> Column:
    """A navigation property as a relation; a collection is one to many."""
    kind = F.coalesce(n["_Type"], F.lit(""))
    role = F.when(n["_ToRole"] != "", n["_ToRole"])
    return relation(
        F.coalesce(n["_Name"], F.lit("")), F.coalesce(role, F.rtrim(F.element_at(F.split(kind, r"\."), -1), F.lit(")"))), F.lit("id"),
        F.when(kind.startswith("Collection("), "one_to_many").otherwise("many_to_one"),
    )


def document_types(body: Column | str) -> Column:
    """Entity types of a metadata document as a list; null for unreadable XML."""
    doc = F.from_xml(col(body), _EDMX, {"ignoreNamespace": "true"})
    # within an array of one, so that the document is parsed once, not wherever its types are looked for
    return F.flatten(F.transform(F.array(doc), _all_types))


def edmx_fields(landed: DataFrame, variant: str = "odata", prefix: str | None = None) -> DataFrame:
    """Fields of every entity type: properties first, then navigation properties.

    `variant` picks what differs between the services: abstract types are skipped and a
    DisplayName annotation described for Dynamics, `sap:label` is the description for SAP.
    A non-null `prefix` column is put before the entity name.
    """
    _, entity_type = VARIANTS[variant]
    found = entity_types(landed, (prefix,) if prefix else ())
    if variant.startswith("dynamics"):
        found = found.filter(~F.col("is_abstract"))

    fields = type_fields(F.col("properties"), F.col("navigations"), F.col("keys"), variant)
    description = (
        F.concat(F.lit("Dynamics 365 Entity: "), "entity") if variant == "dynamics_lib"
        else F.concat(F.lit("SAP OData Entity - "), "entity_hint") if variant == "sap_lib"
        else F.lit(None).cast("string")
    )
    name = F.concat_ws("__", prefix, "entity") if prefix else F.col("entity")
    described = found.select(
        "source_id", "path", "entity_no", name.alias("entity"), F.lit(entity_type).alias("entity_type"),
        description.alias("entity_description"), fields.alias("fields"),
    )
    return explode_fields(described, keep_empty=False)


def edmx_keys(landed: DataFrame) -> DataFrame:
    """Key columns of every entity type, in key order."""
    return (
        entity_types(landed)
        .select("source_id", "path", "entity", F.posexplode_outer("keys").alias("key_no", "field"))
        .filter(F.col("key_no").isNotNull())
    )


def nav_relations(landed: DataFrame) -> DataFrame:
    """Navigation properties as relations."""
    return (
        entity_types(landed)
        .select("source_id", "path", "entity", F.explode("navigations").alias("_n"))
        .select("source_id", F.col("entity").alias("source_entity"), navigation(F.col("_n")).alias("_r"))
        .select("source_id", "source_entity", *[F.col(f"_r.{c}") for c in ("target_entity", "source_field", "target_field", "relation_type")])
    )


# ---- documents too large for one task ----

ELEMENT = "EntityType"
_ONE_TYPE = _ENTITY_TYPE.removeprefix("array<")[:-1]


def element_rows(spark: SparkSession, path: str, tag: str = ELEMENT) -> DataFrame:
    """Entity types of metadata files: file, block (where the split begins), no, at (their order there) and _t.

    A file is cut behind each element's end tag, by as many tasks as it has splits, so no task holds a whole
    document. `tag` is the element's name as the file writes it, with a prefix where it has one. An attribute's
    value must not hold the characters `/>`, nor a comment the element's tags.
    """
    chunks = spark.read.option("lineSep", f"</{tag}>").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.col("value").alias("text"),
    )
    # elements that end in their start tag, then the one that the end tag belongs to
    found = F.regexp_extract_all("text", F.lit(rf"(<{tag}(?=[\s/>])(?:[^>]*/>|[\s\S]*$))"), F.lit(1))
    elements = chunks.select("file", "block", "no", F.posexplode(found).alias("at", "_x"))
    whole = F.when(F.rlike("_x", F.lit(r"^[^>]*/>$")), F.col("_x")).otherwise(F.concat("_x", F.lit(f"</{tag}>")))
    parsed = F.from_xml(whole, _ONE_TYPE, {"ignoreNamespace": "true"})
    return elements.select("file", "block", "no", "at", parsed.alias("_t"))


def edmx_file_fields(spark: SparkSession, path: str, source_id: str, variant: str = "odata", tag: str = ELEMENT) -> DataFrame:
    """Fields of the entity types of metadata files, like `edmx_fields` of the landed documents, however large a file is.

    Entity types are numbered in the order of the file. A file that is no XML gives what elements it has.
    """
    _, entity_type = VARIANTS[variant]
    rows = element_rows(spark, path, tag)
    if variant.startswith("dynamics"):
        rows = rows.withColumn("_abstract", is_abstract(F.col("_t")))
    # places within a split, then splits of a file: a window per split and one over the few splits
    own = Window.partitionBy("file", "block").orderBy("no", "at")
    counted = rows.withColumn("_place", F.row_number().over(own) - 1)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row per split of a file: small however large the files are
    placed = counted.join(F.broadcast(before), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    if variant.startswith("dynamics"):
        placed = placed.filter(~F.col("_abstract"))
    t = F.col("_t")
    description = F.concat(F.lit("Dynamics 365 Entity: "), F.col("entity")) if variant == "dynamics_lib" else F.lit(None).cast("string")
    described = placed.select(
        F.lit(source_id).alias("source_id"), F.col("file").alias("path"), (F.col("_before") + F.col("_place")).cast("int").alias("entity_no"),
        F.coalesce("_t._Name", F.lit("Unknown")).alias("entity"), F.lit(entity_type).alias("entity_type"),
        type_fields(t["Property"], t["NavigationProperty"], type_keys(t), variant).alias("fields"),
    ).withColumn("entity_description", description)
    return explode_fields(described, keep_empty=False)
