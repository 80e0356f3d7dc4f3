"""JSON bodies as ordered entries and typed values, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unisource.functions.text import col

DATE_PREFIX = r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"


def items(body: Column | str) -> Column:
    """Elements of a root list; null for any other root."""
    return F.from_json(col(body), "array<variant>")


def item_texts(body: Column | str) -> Column:
    """Elements of a root list as text, which keeps the key order of objects."""
    return F.from_json(col(body), "array<string>")


def entries(body: Column | str) -> Column:
    """(key, value) pairs of a root object in document order; null for any other root.

    A key given twice keeps its first place and its last value.
    """
    pairs = F.map_entries(F.from_json(col(body), "map<string,variant>"))
    keys = F.transform(pairs, lambda e: e["key"])
    merged = F.transform(
        F.array_distinct(keys),
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"].alias("value"),
        ),
    )
    return F.when(F.size(keys) == F.size(F.array_distinct(keys)), pairs).otherwise(merged)


def as_list(value: Column) -> Column:
    """The value as a list, or null when it is something else."""
    return value.try_cast("array<variant>")


def first_list(pairs: Column, skip_empty: bool) -> Column:
    """The first list-valued entry of an object."""
    lists = F.transform(pairs, lambda e: as_list(e["value"]))
    keep = (lambda x: F.size(x) > 0) if skip_empty else (lambda x: x.isNotNull())
    return F.get(F.filter(lists, keep), 0)


def shaped(pairs: Column) -> Column:
    """Entries with the shape of their value next to it.

    The type ladders below look at the shape in every branch; given it, they do not derive
    it from the value again and again.
    """
    return F.transform(
        pairs,
        lambda e: F.struct(
            e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("shape")
        ),
    )


def value_type(value: Column, shape: Column | None = None) -> Column:
    """Universal type of one JSON value."""
    shape = F.schema_of_variant(value) if shape is None else shape
    return (
        F.when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer")
        # A whole decimal up to 18 digits was written like 1.0; beyond, it is a long integer.
        .when(shape.rlike(r"^DECIMAL\((19|2[0-9]|3[0-9]),0\)$"), "integer")
        .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when((shape == "STRING") & value.try_cast("string").rlike(DATE_PREFIX), "date")
        .otherwise("string")
    )


# ---- fixed values: universal type -> name of the dynamic type in a script ----
_CLASSES = {
    "boolean": "bool", "integer": "int", "float": "float", "object": "dict", "array": "list", "date": "str",
    "string": "str",
}


def value_class(value: Column, shape: Column | None = None) -> Column:
    """Name of the dynamic type a JSON value has when read by a script."""
    shape = F.schema_of_variant(value) if shape is None else shape
    names = F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])
    return F.when(value.isNull() | (shape == "VOID"), "NoneType").otherwise(
        F.element_at(names, value_type(value, shape))
    )


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_readable_object(body: Column | str) -> Column:
    """Whether a text is a JSON object; struct parsing alone turns bad text into null members."""
    return F.json_object_keys(col(body)).isNotNull()
