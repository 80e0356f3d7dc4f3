"""SAGE X3 descriptors and SAGE Business Cloud samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.types import universal_type
from unisource.operators.fields import explode_fields, field, fixed_field, settle
from unisource.operators.records import all_records

# ---- fixed values: objects and resources read by default ----
X3_OBJECTS = [
    "CUSTOMER", "SUPPLIER", "SORDER", "SINVOICE", "GACCENTRY", "ITMMASTER", "FACILITY",
    "BPCUSTOMER", "BPSUPPLIER", "PORDER", "PINVOICE", "BPARTNER",
]
X3_FOLDER = "SEED"
CLOUD_RESOURCES = {
    "ledger_accounts": "Comptes comptables",
    "journals": "Journaux",
    "journal_entries": "Ecritures",
    "contacts": "Contacts",
    "sales_invoices": "Factures ventes",
    "purchase_invoices": "Factures achats",
    "products": "Produits",
    "tax_rates": "TVA",
    "bank_accounts": "Comptes bancaires",
    "payment_methods": "Moyens de paiement",
    "currencies": "Devises",
    "cost_centres": "Centres de cout",
}
SAGE_100_PREFIXES = ["F_", "P_", "G_", "E_", "CBF_", "JM_"]

_DESCRIPTOR = (
    "`$description` string, `$fields` array<struct<`$fieldName`:string,`$type`:string,`$description`:string,"
    "`$isKey`:boolean,`$isForeignKey`:boolean>>"
)


def descriptor(body: Column | str) -> Column:
    """An X3 object descriptor."""
    return F.from_json(body, _DESCRIPTOR)


def descriptor_fields(rows: Column) -> Column:
    def describe(f: Column) -> Column:
        native = F.coalesce(f["$type"], F.lit("A"))
        key = F.coalesce(f["$isKey"], F.lit(False))
        return field(
            F.coalesce(f["$fieldName"], F.lit("")), universal_type(native, "sage_x3"), native,
            nullable=~key, primary_key=key,
            foreign_key=F.coalesce(f["$isForeignKey"], F.lit(False)),
            description=F.coalesce(f["$description"], F.lit("")),
        )

    return F.transform(rows, describe)


def basic_x3_fields() -> Column:
    """Fields of an object whose descriptor is not to be had."""
    return F.array(
        fixed_field("ROWID", "integer", "L", nullable=False, primary_key=True),
        fixed_field("CODE", "string", "A", nullable=False, primary_key=False),
        fixed_field("DESCRIPTION", "string", "A", nullable=True, primary_key=False),
    )


def x3_fields(landed: DataFrame, folder: str = X3_FOLDER, variant: str = "live") -> DataFrame:
    """Fields of X3 object descriptors.

    An object the server refuses gets three basic fields and an unreadable reply is
    skipped; the `lib` variant does it the other way round and takes the description from
    the descriptor.
    """
    doc = landed.select(
        "source_id", "path", "entity_hint", (F.coalesce("status", F.lit(200)) < 400).alias("_ok"),
        descriptor("body").alias("_d"), J.is_readable_object("body").alias("_readable"),
    ).filter(F.col("_ok") if variant == "lib" else ~F.col("_ok") | F.col("_readable"))
    detailed = F.col("_readable") if variant == "lib" else F.col("_ok")

    if variant == "lib":
        named = F.concat(F.lit("SAGE X3 Object "), "entity_hint")
        description = F.when(detailed, F.coalesce("_d.$description", named)).otherwise(
            F.concat(named, F.lit(" (non détaillé)"))
        )
    else:
        description = F.concat(F.lit(f"SAGE X3 - {folder} - "), "entity_hint")
    entities = doc.select(
        "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"),
        F.lit("sage_x3_object").alias("entity_type"),
        description.alias("entity_description"),
        F.when(detailed, descriptor_fields(F.col("_d")["$fields"])).otherwise(basic_x3_fields()).alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)


def cloud_fields(
    landed: DataFrame, labels: dict[str, str] | None = None, variant: str = "live", mode: str = "first"
) -> DataFrame:
    """Fields of the records a resource returns; refused or unreadable replies are skipped.

    Mode `first` takes those of the first record, `all` those of all records (see `records.all_records`). An
    empty sample has no fields, in the `lib` variant the two fields every resource has; so has a sample whose first
    record, or in mode `all` every record, is no object.
    """
    labels = CLOUD_RESOURCES if labels is None else labels
    parsed = landed.filter(F.coalesce("status", F.lit(200)) < 400).select(
        "source_id", "path", "entity_hint", J.entries("body").alias("_pairs"),
        F.from_json("body", "map<string,string>").alias("_texts"),
    )
    doc = settle(parsed, "_pairs", "_texts").filter(F.col("_pairs").isNotNull())
    keys = F.transform("_pairs", lambda e: e["key"])
    chosen = F.when(F.array_contains(keys, "$items"), "$items").when(F.array_contains(keys, "value"), "value")
    value = F.get(F.filter("_pairs", lambda e: e["key"] == F.col("_key")), 0)["value"]
    chosen_items = (
        doc.withColumn("_key", chosen)
        .withColumn("_items", J.as_list(value))
        .withColumn("_null", F.is_variant_null(value))
        .withColumn("_text", F.try_element_at("_texts", F.col("_key")))
    )
    # null items are none; a reply whose items are anything else than a list cannot be sampled
    listed = settle(chosen_items, "_key", "_items", "_null").filter(
        F.col("_key").isNull() | F.col("_items").isNotNull() | F.col("_null")
    )
    first = F.get("_items", 0)
    if mode == "all":
        sampled = listed.select("source_id", "path", "entity_hint", "_items", J.item_texts("_text").alias("_texts"), F.lit(True).alias("_found"))
        merged = all_records(sampled)
        own = F.transform("keys", lambda k: cloud_field(k["name"], k["type"], k["class"]))
        usable = F.col("n_objects") > 0 if variant == "lib" else (F.col("n_objects") > 0) | (F.col("n_records") == 0)
        return _cloud_entities(merged, F.coalesce(F.when(usable, own), basic_cloud_fields()), labels)
    sample = F.when(F.size("_items") > 0, F.when(J.is_object(first), J.entries(F.get(J.item_texts("_text"), 0)))).otherwise(
        F.array().cast("array<struct<key:string,value:variant>>")
    )

    sampled = F.when(F.size("_sample") > 0, F.col("_sample")) if variant == "lib" else F.col("_sample")
    described = F.transform(
        J.shaped(sampled), lambda e: cloud_field(e["key"], J.value_type(e["value"], e["shape"]), J.value_class(e["value"], e["shape"]))
    )
    # a first item that is no object falls back to the basic fields
    return _cloud_entities(listed.withColumn("_sample", sample), F.coalesce(described, basic_cloud_fields()), labels)


def cloud_field(key: Column, type: Column, native_type: Column) -> Column:
    return field(key, type, native_type, primary_key=key == "id", foreign_key=key.endswith("_id") & (key != "id"))


def basic_cloud_fields() -> Column:
    return F.array(
        fixed_field("id", "uuid", "string", nullable=False, primary_key=True),
        fixed_field("display_name", "string", "string", nullable=True, primary_key=False),
    )


def cloud_label(resource: Column, labels: dict[str, str]) -> Column:
    if not labels:
        return resource
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), resource), resource)


def _cloud_entities(resources: DataFrame, fields: Column, labels: dict[str, str]) -> DataFrame:
    label = cloud_label(F.col("entity_hint"), labels)
    entities = resources.select(
        "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"),
        F.lit("sage_cloud_resource").alias("entity_type"),
        F.concat(F.lit("SAGE Business Cloud - "), label).alias("entity_description"), fields.alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)
