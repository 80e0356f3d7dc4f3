"""Discovery of every dialect in one pass over the landed payloads.

A payload is routed by its dialect, a file by its first character, and parsed once, where it was read. What comes out
of any dialect are cells: a field, a relation, a listed name or a record's key. Cells are merged by one aggregation
that combines within each task before the exchange, and staged; the joins that some dialects need (listings, service
names, attributes of definitions) read those few rows, never the payloads again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.text import entity_name_from_path, first_page, non_empty, page_number, starts_with_any, strip
from unisource.operators import dictionary, dynamics, edmx, fields, sage, sap
from unisource.operators.fields import FIELDS, RELATIONS, explode_fields, field
from unisource.schemas import DISCOVERED_COLUMNS
from unisource.session import staged

RECORD_ROUTES = ("rest", "file_json", "sage_cloud")
#: Dialects that go another way than their own name says; files without a known format go by their first character.
ROUTES = {"graphql": "rest", "soap": "rest"}
FILES = ("file", "file_excel")
DIRECT = ("odata", "sage_x3", "bapi", "sql", "sage_100")

_FIELD = FIELDS.removeprefix("array<")[:-1]
_RELATION = RELATIONS.removeprefix("array<")[:-1]
_CELL = (
    "kind string, entity_no int, entity string, entity_type string, entity_description string, at int, "
    f"field {_FIELD}, relation {_RELATION}"
)
_CELLS = f"array<struct<{_CELL}>>"
_PAYLOAD = ["source_id", "path", "entity_hint"]
_HEADER = ["entity_no", "entity", "entity_type", "entity_description"]


@dataclass
class Discovery:
    """What a sync found: `fields` as `discover` gives them, `relations` between entities by name, and files to read as CSV."""

    fields: DataFrame
    relations: DataFrame
    csv_files: DataFrame

    def summary(self) -> DataFrame:
        return fields.sync_summary(self.fields, self.relations)


def _text() -> Column:
    """The body, that of a file without its byte order mark."""
    return F.when(F.col("dialect").isin(*FILES), F.regexp_replace("body", "^\\ufeff", "")).otherwise(F.col("body"))


def route() -> Column:
    """Which way a payload goes."""
    dialect = F.col("dialect")
    by_name = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    first = F.substring(strip(_text()), 1, 1)
    return (
        F.when(dialect.isin(*FILES), F.when(first.isin("{", "["), "file_json").otherwise("file_csv"))
        .otherwise(F.coalesce(F.try_element_at(by_name, dialect), dialect))
    )


def _cell(kind: str, at: Column, field: Column | None = None, header: list[Column] | None = None, relation: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind), *(header or [none] * 4), at, none if field is None else field, none if relation is None else relation).cast(f"struct<{_CELL}>")


def _none() -> Column:
    return F.array().cast(_CELLS)


def _entity_cells(no: Column, entity: Column, entity_type: str, description: Column, own: Column, relations: Column | None = None, keep: bool = False) -> Column:
    """Cells of one entity's fields and relations; an entity to keep has one without a field where it has none."""
    header = [no, entity, F.lit(entity_type), description]
    cells = F.coalesce(F.transform(own, lambda f, i: _cell("entity", i, f, header)), _none())
    if keep:
        cells = F.when(F.size(cells) > 0, cells).otherwise(F.array(_cell("entity", F.lit(-1), None, header)))
    if relations is None:
        return cells
    related = F.coalesce(F.transform(relations, lambda r, i: _cell("relation", i, None, header, r)), _none())
    return F.when(F.size(cells) > 0, F.concat(cells, related)).otherwise(cells)


def _metadata_cells(folder: str = sage.X3_FOLDER) -> Column:
    """Cells of a payload that describes entities or lists names; null for other routes and for what cannot be read."""
    at, hint, body = F.col("_route"), F.col("entity_hint"), F.col("body")
    good = F.coalesce("status", F.lit(200)) < 400
    none = F.lit(None).cast("string")

    def documents(variant: str) -> Column:
        _, entity_type = edmx.VARIANTS[variant]

        def cells(t: Column, i: Column) -> Column:
            own = edmx.type_fields(t["Property"], t["NavigationProperty"], edmx.type_keys(t), variant)
            found = _entity_cells(i, F.coalesce(t["_Name"], F.lit("Unknown")), entity_type, none, own, F.transform(t["NavigationProperty"], edmx.navigation))
            return F.when(edmx.is_abstract(t), _none()).otherwise(found) if variant == "dynamics" else found

        return F.flatten(F.transform(edmx.document_types(body), cells))

    def names(kind: str, listed: Column) -> Column:
        return F.transform(listed, lambda n, i: _cell(kind, i, field(n, none, none)))

    def table(variant: str, entity_type: str, description: Column) -> Column:
        doc = F.from_json(body, dictionary.TABLE)
        return F.flatten(F.transform(F.array(doc), lambda d: _entity_cells(
            F.lit(0), hint, entity_type, description, dictionary.table_fields(d, variant), dictionary.table_relations(d)
        )))

    x3 = F.when(good, sage.descriptor_fields(sage.descriptor(body)["$fields"])).otherwise(sage.basic_x3_fields())
    described = F.concat(F.lit(f"SAGE X3 - {folder} - "), hint)
    return (
        F.when((at == "odata") & good, documents("odata"))
        .when((at == "sap_odata") & good, documents("sap"))
        .when((at == "dynamics_edmx") & good, documents("dynamics"))
        .when(at == "abap", _entity_cells(F.lit(0), hint, "sap_table", none, sap.structure_fields(sap.structure(body))))
        .when((at == "bapi") & J.is_readable_object("body"), _entity_cells(
            F.lit(0), hint, "sap_bapi", none, sap.interface_fields(sap.interface(body)), keep=True
        ))
        .when((at == "sage_x3") & (~good | J.is_readable_object("body")), _entity_cells(F.lit(0), hint, "sage_x3_object", described, x3, keep=True))
        .when((at == "dynamics_entities") & good, F.flatten(F.transform(dynamics.definition_rows(body), lambda d, i: _entity_cells(
            i, dynamics.definition_name(d), "dynamics_entity", dynamics.definition_label(d), dynamics.primary_fields(d)
        ))))
        .when((at == "dynamics_attributes") & good, F.transform(dynamics.attribute_rows(body), lambda f, i: _cell("attribute", i, f)))
        .when((at == "abap_listing") & good, names("listed", sap.listing(body)))
        .when((at == "sap_services") & good, names("listed", sap.service_names(body)))
        .when(at == "sql", table("live", "table", none))
        .when((at == "sage_100") & starts_with_any(hint, sage.SAGE_100_PREFIXES), table("sage100", "sage100_table", F.concat(F.lit("Table SAGE 100 "), hint)))
        .when(at == "file_csv", F.array(_cell("listed", F.lit(0), field(F.col("path"), none, none))))
    )


def _records() -> Column:
    """Records of a payload as (item, text); an empty list without any, null where it is not of records or cannot be read."""
    at, pairs, items = F.col("_route"), F.col("_pairs"), F.col("_items")
    keys = F.transform(pairs, lambda e: e["key"])
    cloud_key = F.when(F.array_contains(keys, "$items"), "$items").when(F.array_contains(keys, "value"), "value")
    file_key = F.get(F.filter(pairs, lambda e: F.size(J.as_list(e["value"])) > 0), 0)["key"]
    key = F.when(at == "sage_cloud", cloud_key).when((at == "file_json") & items.isNull(), file_key)
    value = F.get(F.filter(pairs, lambda e: e["key"] == key), 0)["value"]
    text = F.try_element_at(F.from_json("body", "map<string,string>"), key)
    whole = F.array(F.struct(F.try_parse_json("body").alias("item"), F.col("body").alias("text")))
    empty = F.array().cast("array<struct<item:variant,text:string>>")

    def zipped(some: Column, source: Column) -> Column:
        return F.arrays_zip(some.alias("item"), J.item_texts(source).alias("text"))

    inner = F.when(key.isNotNull(), zipped(J.as_list(value), text))
    bare = F.when(F.try_parse_json("body").isNotNull(), empty)
    good = F.coalesce("status", F.lit(200)) < 400
    cloud = F.when(good & pairs.isNotNull(), F.when(key.isNull() | F.is_variant_null(value), empty).otherwise(inner))
    plain = F.coalesce(F.when(items.isNotNull(), zipped(items, F.col("body"))), inner, F.when(pairs.isNotNull(), whole), bare)
    return F.when(at == "sage_cloud", cloud).when(at.isin("rest", "file_json"), plain)


def facts(landed: DataFrame) -> DataFrame:
    """All cells of all payloads, merged: equal ones are one, and the same key of a payload's records is one."""
    parses = F.col("_route").isin(*RECORD_ROUTES)
    routed = landed.select(*_PAYLOAD, "status", _text().alias("body"), route().alias("_route"))
    opened = routed.select(
        "*", F.when(parses, J.items("body")).alias("_items"), F.when(parses, J.entries("body")).alias("_pairs")
    )
    listed = opened.select(
        *_PAYLOAD, "_route", _metadata_cells().alias("_cells"), _records().alias("_records"),
        (F.col("_items").isNotNull() | F.col("_pairs").isNotNull()).alias("_found"),
    )
    records = listed.select(
        *_PAYLOAD, "_route", "_cells", "_found", F.col("_records").isNotNull().alias("_typed"), F.posexplode_outer("_records").alias("_no", "_r")
    )
    is_object = F.coalesce(J.is_object(F.col("_r.item")), F.lit(False))
    keyed = records.select(
        *_PAYLOAD, "_route", "_cells", "_found", "_typed", "_no", is_object.alias("_object"),
        J.shaped(F.when(is_object, J.entries(F.col("_r.text")))).alias("_keys"),
    )
    none = F.lit(None)
    keys = F.transform("_keys", lambda e, i: F.struct(
        _cell("key", i, field(e["key"], J.value_type(e["value"], e["shape"]), J.value_class(e["value"], e["shape"]))).alias("cell"),
        (e["shape"] != "VOID").alias("filled"),
    ))
    no_key = F.array(F.struct(_cell("key", none).alias("cell"), F.lit(False).alias("filled")))
    described = F.transform("_cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("filled")))
    cells = keyed.select(
        *_PAYLOAD, "_route", "_found", "_no", "_object",
        F.explode(F.when(F.col("_typed"), F.when(F.size("_keys") > 0, keys).otherwise(no_key)).otherwise(described)).alias("_c"),
    ).select(*_PAYLOAD, "_route", "_found", "_no", "_object", "_c.filled", "_c.cell.*")
    is_key = F.col("kind") == "key"
    paged = is_key | (F.col("kind") != "entity") & (F.col("kind") != "relation")
    placed = cells.withColumn("page", page_number("path")).withColumn("path", F.when(paged, first_page("path")).otherwise(F.col("path")))
    counted = is_key & F.col("_no").isNotNull() & (F.coalesce("at", F.lit(0)) == 0)
    value = F.when(F.col("filled"), F.col("field.type")), F.when(F.col("filled"), F.col("field.native_type"))
    return placed.groupBy(
        "_route", "kind", *_PAYLOAD, *_HEADER, F.when(~is_key, F.struct("page", "at")).alias("slot"), F.col("field.name").alias("name")
    ).agg(
        F.min(F.struct("at", "page", "_no")).alias("first"), F.min("field").alias("field"), F.min("relation").alias("relation"),
        F.min(value[0]).alias("type_low"), F.max(value[0]).alias("type_high"), F.min(value[1]).alias("class_low"), F.max(value[1]).alias("class_high"),
        F.count_if(counted).alias("records"), F.count_if(counted & F.col("_object")).alias("objects"), F.bool_or("_found").alias("found"),
    )


def _described(found: DataFrame) -> DataFrame:
    """Entity cells as discovered fields."""
    own = {c: F.col(f"field.{c}") for c in ("name", "type", "native_type", "nullable", "primary_key", "foreign_key", "description")}
    own["position"] = F.when(F.col("slot.at") >= 0, F.col("slot.at"))
    return found.select(*[own.get(c, F.col(c)).alias(c) for c in DISCOVERED_COLUMNS])


def _typed(found: DataFrame, cloud_labels: dict[str, str]) -> DataFrame:
    """Fields of payloads of records, from their merged keys."""
    kind = F.when(F.col("type_low") == F.col("type_high"), F.col("type_low")).otherwise("string")
    native = F.when(F.col("class_low").isNull(), "NoneType").when(F.col("class_low") == F.col("class_high"), F.col("class_low")).otherwise("str")
    key = F.struct("first", "name", kind.alias("type"), native.alias("class"))
    merged = found.groupBy("_route", *_PAYLOAD).agg(
        F.sum("records").alias("records"), F.sum("objects").alias("objects"), F.bool_or("found").alias("found"),
        F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), key))).alias("keys"),
    )
    at = F.col("_route")
    usable = (F.col("objects") > 0) | (F.col("records") == 0)
    shown = F.when(F.col("found"), F.format_string("JSON - %d enregistrements, %d champs", "records", F.size("keys")))
    cloud = F.when(usable, F.transform("keys", lambda k: sage.cloud_field(k["name"], k["type"], k["class"]))).otherwise(sage.basic_cloud_fields())
    own = F.when(at == "sage_cloud", cloud).otherwise(
        F.transform("keys", lambda k: field(k["name"], k["type"], F.when(at == "file_json", "json_field")))
    )
    entities = merged.filter(usable | (at != "rest")).select(
        "source_id", "path", F.lit(0).alias("entity_no"),
        F.when(at == "rest", F.coalesce(non_empty("entity_hint"), entity_name_from_path("path"))).otherwise(F.col("entity_hint")).alias("entity"),
        F.when(at == "rest", "endpoint").when(at == "file_json", "file").otherwise("sage_cloud_resource").alias("entity_type"),
        F.when(at == "file_json", shown).when(
            at == "sage_cloud", F.concat(F.lit("SAGE Business Cloud - "), sage.cloud_label(F.col("entity_hint"), cloud_labels))
        ).alias("entity_description"),
        own.alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)


def discover_all(landed: DataFrame, cloud_labels: dict[str, str] | None = None) -> Discovery:
    """Fields and relations of every landed payload, read in one scan.

    The fields are those of `sync.discover`, with the tables of dictionaries (`dictionary.land_dictionary`) and files of either
    format besides. Relations are navigation properties, and foreign keys whose referred table is listed too. Repeated
    payloads count once. Null statuses count as good ones; unknown dialects give nothing.
    """
    found = staged(facts(landed), "facts")

    def of(*routes: str, kind: str = "entity") -> DataFrame:
        return found.filter(F.col("_route").isin(*routes) & (F.col("kind") == kind))

    # ABAP tables of a listing, all where a source has no usable one
    listed = of("abap_listing", kind="listed").select("source_id", F.col("name").alias("entity_hint")).distinct()
    lists = listed.select("source_id").distinct().withColumn("_lists", F.lit(True))
    abap = of("abap").join(listed.withColumn("_listed", F.lit(True)), ["source_id", "entity_hint"], "left").join(lists, "source_id", "left")
    abap = abap.filter(F.col("_listed").isNotNull() | F.col("_lists").isNull())

    # service names go before entity names where a gateway has several services
    services = of("sap_services", kind="listed").select("source_id", F.col("name").alias("entity_hint"))
    many = services.groupBy("source_id").agg((F.count("*") > 1).alias("_several"))
    called = services.distinct().withColumn("_named", F.lit(True))

    def of_services(kind: str) -> DataFrame:
        met = of("sap_odata", kind=kind).join(many, "source_id", "left").join(called, ["source_id", "entity_hint"], "left")
        kept = met.filter(F.col("_named").isNotNull() | F.col("_several").isNull())
        return kept.withColumn("_prefix", F.when(F.col("_several"), F.col("entity_hint")))

    gateway = of_services("entity").withColumn("entity", F.concat_ws("__", "_prefix", "entity"))

    # definitions with the attributes of all their pages; metadata documents of sources without definitions
    defined = of("dynamics_entities")
    attribute = F.struct("path", "slot", "field")
    own = F.transform(F.sort_array(F.collect_list(attribute)), lambda a: a["field"])
    attributes = of("dynamics_attributes", kind="attribute").filter("entity_hint is not null").groupBy("source_id", F.col("entity_hint").alias("entity")).agg(own.alias("_own"))
    basic = F.transform(F.sort_array(F.collect_list(F.struct("slot", "field"))), lambda a: a["field"])
    definitions = defined.groupBy("source_id", "path", *_HEADER).agg(basic.alias("_basic")).join(attributes, ["source_id", "entity"], "left")
    crm = explode_fields(definitions.withColumn("fields", F.coalesce("_own", "_basic")), keep_empty=False)
    covered = defined.select("source_id").distinct()

    parts = [
        _described(of(*DIRECT)), _described(abap), _described(gateway), crm,
        _described(of("dynamics_edmx").join(covered, "source_id", "left_anti")),
        _typed(of(*RECORD_ROUTES, kind="key"), sage.CLOUD_RESOURCES if cloud_labels is None else cloud_labels),
    ]

    def related(rows: DataFrame, prefix: Column | None = None) -> DataFrame:
        name = (lambda c: F.concat_ws("__", prefix, c)) if prefix is not None else F.col
        return rows.select(
            "source_id", name("entity").alias("source_entity"), name("relation.target_entity").alias("target_entity"),
            "relation.source_field", "relation.target_field", "relation.relation_type",
        )

    tables = of("sql", "sage_100").select("source_id", F.col("entity").alias("target_entity")).distinct()
    relations = [
        related(of("odata", kind="relation")), related(of_services("relation"), F.col("_prefix")),
        related(of("dynamics_edmx", kind="relation").join(covered, "source_id", "left_anti")),
        related(of("sql", "sage_100", kind="relation")).join(tables, ["source_id", "target_entity"], "left_semi").select(
            "source_id", "source_entity", "target_entity", "source_field", "target_field", "relation_type"
        ),
    ]
    csv = of("file_csv", kind="listed").select("source_id", F.col("entity_hint").alias("entity"), F.col("name").alias("path"))
    return Discovery(reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, relations), csv)
