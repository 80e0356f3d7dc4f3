"""Rows and fields out of landed JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.text import entity_name_from_path, first_page, non_empty, page_number
from unisource.operators.fields import explode_fields, field, settle


def _whole(body: str) -> Column:
    return F.array(F.try_parse_json(F.col(body)))


def rest_rows(landed: DataFrame) -> DataFrame:
    """Root list, else the first list-valued key (empty ones count), else the object."""
    parsed = landed.select(
        "source_id", "path", "body", J.items("body").alias("_items"), J.entries("body").alias("_pairs")
    )
    rows = F.coalesce(
        "_items",
        J.first_list(F.col("_pairs"), skip_empty=False),
        F.when(F.col("_pairs").isNotNull(), _whole("body")),
    )
    return parsed.select("source_id", "path", F.posexplode(rows).alias("row_no", "row"))


def odata_rows(landed: DataFrame) -> DataFrame:
    """The `value` list of an object, else the object itself as one row."""
    value = F.try_variant_get("_doc", "$.value", "array<variant>")
    rows = F.when(J.is_object(F.col("_doc")), F.coalesce(value, F.array("_doc")))
    return (
        landed.select("source_id", "path", F.try_parse_json("body").alias("_doc"))
        .select("source_id", "path", F.posexplode(rows).alias("row_no", "row"))
    )


def file_records(landed: DataFrame) -> DataFrame:
    """Root list, else the first list that is not empty, else the object."""
    parsed = landed.select(
        "source_id", "path", "body", J.items("body").alias("_items"), J.entries("body").alias("_pairs")
    )
    rows = F.coalesce(
        "_items",
        J.first_list(F.col("_pairs"), skip_empty=True),
        F.when(F.col("_pairs").isNotNull(), _whole("body")),
    )
    return parsed.select("source_id", "path", F.posexplode(rows).alias("row_no", "row"))


def unreadable(landed: DataFrame) -> DataFrame:
    """Bodies no JSON operator can read, kept for inspection in a `_corrupt` column."""
    bad = F.col("body").isNotNull() & J.items("body").isNull() & J.entries("body").isNull() & F.try_parse_json(
        "body"
    ).isNull()
    return landed.filter(bad).select("source_id", "path", F.col("body").alias("_corrupt"))


def _parsed(landed: DataFrame) -> DataFrame:
    """Readable bodies as list items or object entries; a bare value has neither."""
    parsed = landed.select(
        "source_id", "path", "entity_hint", "body",
        J.items("body").alias("_items"), J.entries("body").alias("_pairs"),
    )
    bare = F.col("_items").isNull() & F.col("_pairs").isNull()
    readable = settle(
        parsed.withColumn("_readable", ~bare | F.try_parse_json("body").isNotNull()), "_items", "_pairs", "_readable"
    )
    return readable.filter("_readable").drop("_readable")


def _json_fields(pairs: Column, native_type: Column) -> Column:
    return F.transform(
        J.shaped(pairs), lambda e: field(e["key"], J.value_type(e["value"], e["shape"]), native_type)
    )


def all_records(sampled: DataFrame, merge_numeric: bool = False) -> DataFrame:
    """What the records of each payload have in common: one row per source_id, path and entity_hint.

    `sampled`: also _items (the records as a list, null or empty without any), _texts (the same as texts) and _found (whether the
    body is a list or an object). Columns found, n_records, n_objects (records that are objects) and keys: position, name, type and class (the type's name in a script) of each key
    of any record, by its smallest position, then by the first page and record that has it there.

    A key has the type that all its values but nulls share, else string; an integer and a float are both float
    with `merge_numeric`. Pages of one endpoint are one payload. The merge is associative: a task sends one row per
    payload and key, however many records it read.
    """
    payload = ["source_id", "path", "entity_hint"]
    records = sampled.select(
        "source_id", first_page("path").alias("path"), "entity_hint", page_number("path").alias("_page"), "_found",
        F.posexplode_outer(F.arrays_zip(F.col("_items").alias("item"), F.col("_texts").alias("text"))).alias("_no", "_r"),
    )
    is_object = J.is_object(F.col("_r.item"))
    cells = records.select(
        *payload, "_page", "_no", "_found", is_object.alias("_object"),
        F.posexplode_outer(J.shaped(F.when(is_object, J.entries(F.col("_r.text"))))).alias("_at", "_e"),
    )
    typed = cells.select(
        *payload, "_page", "_no", "_at", "_found", "_object", F.col("_e.key").alias("name"), (F.col("_e.shape") != "VOID").alias("_filled"),
        J.value_type(F.col("_e.value"), F.col("_e.shape")).alias("_type"), J.value_class(F.col("_e.value"), F.col("_e.shape")).alias("_class"),
    )
    # a record is counted at its first key, or where it has none
    counted = F.col("_no").isNotNull() & (F.coalesce("_at", F.lit(0)) == 0)
    by_key = typed.groupBy(*payload, "name").agg(
        F.min(F.struct("_at", "_page", "_no")).alias("_first"), F.count_if(counted).alias("_records"),
        F.count_if(counted & F.col("_object")).alias("_objects"), F.bool_or("_found").alias("_found"),
        *[f(F.when(F.col("_filled"), F.col(c))).alias(f"{c}{end}") for c in ("_type", "_class") for f, end in ((F.min, "_low"), (F.max, "_high"))],
    )

    def shared(column: str, mixed: Column, none: str) -> Column:
        low, high = F.col(f"{column}_low"), F.col(f"{column}_high")
        numbers = (low == "float") & ((high == "integer") | (high == "int"))
        same = F.when(low == high, low).when(low.isNull(), none)
        return (same.when(numbers, "float") if merge_numeric else same).otherwise(mixed)

    key = F.struct(
        "_first", "name", shared("_type", F.lit("string"), "string").alias("type"), shared("_class", F.lit("str"), "NoneType").alias("class")
    )
    return by_key.groupBy(*payload).agg(
        F.bool_or("_found").alias("found"), F.sum("_records").alias("n_records"), F.sum("_objects").alias("n_objects"),
        F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), key))).alias("keys"),
    )


def _record_fields(native_type: Column) -> Column:
    return F.transform("keys", lambda k: field(k["name"], k["type"], native_type))


def _listed(body: str, pairs: Column, items: Column, texts: Column) -> list[Column]:
    """The records of a body as _items and _texts: those of a list, or the object as the only one."""
    whole = pairs.isNotNull()
    return [
        F.coalesce(items, F.when(whole, _whole(body))).alias("_items"),
        F.coalesce(texts, F.when(whole, F.array(F.col(body)))).alias("_texts"),
        (whole | items.isNotNull()).alias("_found"),
    ]


def endpoint_fields(landed: DataFrame, variant: str = "live", mode: str = "first") -> DataFrame:
    """Entity of a REST endpoint: keys of a list's items, or of the object.

    Mode `first` looks at the first item only, `all` at every item of every page (see `all_records`). An empty list or a
    bare value gives an entity without fields (none in the `lib` variant, which also flattens slashes in
    names), a list of bare values gives none.
    """
    if mode == "all":
        texts = F.when(F.col("_items").isNotNull(), J.item_texts("body"))
        sampled = _parsed(landed).select("source_id", "path", "entity_hint", *_listed("body", F.col("_pairs"), F.col("_items"), texts))
        merged = all_records(sampled).filter((F.col("n_objects") > 0) | ((F.col("n_records") == 0) & F.lit(variant != "lib")))
        named = F.coalesce(non_empty("entity_hint"), entity_name_from_path("path", flatten=variant == "lib"))
        return explode_fields(merged.select(
            "source_id", "path", F.lit(0).alias("entity_no"), named.alias("entity"), F.lit("endpoint").alias("entity_type"),
            F.lit(None).cast("string").alias("entity_description"), _record_fields(F.lit(None)).alias("fields"),
        ), keep_empty=True)
    first = F.get("_items", 0)
    usable = F.col("_items").isNull() | (F.size("_items") == 0) | J.is_object(first)
    if variant == "lib":
        usable = F.col("_pairs").isNotNull() | J.is_object(first)
    sampled = _parsed(landed).filter(usable).select(
        "source_id", "path", "entity_hint",
        F.when(F.size("_items") > 0, J.entries(F.get(J.item_texts("body"), 0)))
        .otherwise(F.col("_pairs")).alias("_sample"),
    )
    named = F.coalesce(non_empty("entity_hint"), entity_name_from_path("path", flatten=variant == "lib"))
    entities = sampled.select(
        "source_id", "path", F.lit(0).alias("entity_no"), named.alias("entity"),
        F.lit("endpoint").alias("entity_type"),
        F.lit(None).cast("string").alias("entity_description"),
        _json_fields(F.col("_sample"), F.lit(None)).alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)


def json_file_fields(landed: DataFrame, mode: str = "first") -> DataFrame:
    """Entity of a JSON file, described by its record and field counts.

    Mode `first` takes the fields of the first record, `all` those of all records (see `all_records`).
    """
    parsed = _parsed(landed)
    nested_key = F.get(
        F.filter("_pairs", lambda e: F.size(J.as_list(e["value"])) > 0), 0
    )["key"]
    keyed = parsed.withColumn("_key", nested_key)
    nested_items = J.first_list(F.col("_pairs"), skip_empty=True)
    # The text form of the chosen list keeps the key order that a variant loses.
    nested_text = F.try_element_at(F.from_json("body", "map<string,string>"), F.col("_key"))
    list_items = F.coalesce("_items", nested_items)
    list_text = F.when(F.col("_items").isNotNull(), F.col("body")).otherwise(nested_text)
    if mode == "all":
        whole = keyed.withColumn("_list", list_items).withColumn("_text", list_text)
        sampled = whole.select("source_id", "path", "entity_hint", *_listed("body", F.col("_pairs"), F.col("_list"), J.item_texts("_text")))
        described = F.format_string("JSON - %d enregistrements, %d champs", "n_records", F.size("keys"))
        return explode_fields(all_records(sampled).select(
            "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"), F.lit("file").alias("entity_type"),
            F.when(F.col("found"), described).alias("entity_description"), _record_fields(F.lit("json_field")).alias("fields"),
        ), keep_empty=True)
    sampled = keyed.withColumn("_list", list_items).withColumn("_text", list_text).select(
        "source_id", "path", "entity_hint",
        (F.col("_items").isNull() & F.col("_pairs").isNull()).alias("_bare"),
        F.when(F.col("_list").isNotNull(), F.size("_list"))
        .when(F.col("_pairs").isNotNull(), 1).alias("n_records"),
        F.when(
            F.col("_list").isNotNull(),
            F.when(J.is_object(F.get("_list", 0)), J.entries(F.get(J.item_texts("_text"), 0))),
        ).otherwise(F.col("_pairs")).alias("_sample"),
    )
    n_fields = F.coalesce(F.size(F.col("_sample")), F.lit(0))
    entities = sampled.select(
        "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"),
        F.lit("file").alias("entity_type"),
        F.when(
            ~F.col("_bare"),
            F.format_string(
                "JSON - %d enregistrements, %d champs",
                F.col("n_records"),
                F.when(F.col("_sample").isNull(), 0).otherwise(n_fields),
            ),
        ).alias("entity_description"),
        _json_fields(F.col("_sample"), F.lit("json_field")).alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)


def record_types(records: DataFrame, keys: list[str], body: str = "body", merge_numeric: bool = False) -> DataFrame:
    """Fields over all records of a group, not only its first one.

    A key keeps its smallest place; its type is the one all its non-null values share, else string.
    """
    kinds = (
        records.select(*keys, F.posexplode(J.shaped(J.entries(body))).alias("position", "_e"))
        .select(
            *keys, "position", F.col("_e.key").alias("name"),
            J.value_type(F.col("_e.value"), F.col("_e.shape")).alias("_type"),
            (F.col("_e.shape") != "VOID").alias("_filled"),
        )
    )
    kind = F.when(F.col("_filled"), F.col("_type"))
    both_numbers = (F.col("_low") == "float") & (F.col("_high") == "integer")
    merged = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    if merge_numeric:
        # float and integer are neighbours in text order among the types, so low/high shows the pair
        merged = merged.when(both_numbers, "float")
    return (
        kinds.groupBy(*keys, "name")
        .agg(
            F.min("position").alias("position"),
            F.count("*").alias("n_records"),
            F.count_if("_filled").alias("n_values"),
            F.min(kind).alias("_low"),
            F.max(kind).alias("_high"),
        )
        .select(*keys, "name", "position", merged.otherwise("string").alias("type"), "n_records", "n_values")
    )
