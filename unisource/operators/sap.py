"""SAP: table listings, ABAP dictionary, function interfaces and gateway services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unisource.functions import json as J
from unisource.functions.text import first_page, non_empty, page_number, strip
from unisource.functions.types import universal_type
from unisource.operators.edmx import edmx_fields
from unisource.operators.fields import explode_fields, field

# ---- fixed values ----
TABLE_CLASS = "TRANSP"

_LISTING = "FIELDS array<struct<FIELDNAME:string,OFFSET:string,LENGTH:string>>, DATA array<struct<WA:string>>"
_STRUCTURE = "FIELDS array<struct<FIELDNAME:string,DATATYPE:string,KEYFLAG:string,FIELDTEXT:string>>"
_INTERFACE = "PARAMS_AND_EXCPS array<struct<PARAMETER:string,TABNAME:string,PARAMTEXT:string>>"


def rfc_rows(landed: DataFrame, row_count: int | None = None) -> DataFrame:
    """Stripped work areas of a table read, blank ones dropped; all of them, or at most `row_count` read per call.

    Refused requests have none.
    """
    if "status" in landed.columns:
        landed = landed.filter(F.coalesce("status", F.lit(200)) < 400)
    data = F.from_json("body", _LISTING)["DATA"]
    if row_count is not None:
        data = F.slice(data, 1, row_count)
    return (
        landed.select("source_id", "path", F.posexplode(data).alias("row_no", "_d"))
        .select("source_id", "path", "row_no", strip("_d.WA").alias("wa"))
        .filter(F.col("wa") != "")
    )


def rfc_columns(
    landed: DataFrame, fields: list[str], row_count: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Wide table reads cut into columns by the offsets the reply lists for its fields.

    `where` filters on the cut columns, `fields` projects, `row_count` caps each call's rows.
    """
    doc = landed.select("source_id", "path", F.from_json("body", _LISTING).alias("_d"))
    layout = F.map_from_entries(
        F.transform("_d.FIELDS", lambda f: F.struct(f["FIELDNAME"], f))
    )
    rows = doc.select("source_id", "path", layout.alias("_l"), F.posexplode("_d.DATA").alias("row_no", "_r"))
    cut = rows.select(
        "source_id", "path", "row_no",
        *[
            strip(
                F.substring(
                    F.col("_r.WA"),
                    F.try_element_at("_l", F.lit(f))["OFFSET"].try_cast("int") + 1,
                    F.try_element_at("_l", F.lit(f))["LENGTH"].try_cast("int"),
                )
            ).alias(f)
            for f in fields
        ],
    )
    if where is not None:
        cut = cut.filter(where)
    if row_count is not None:
        # rank filters are cut before the exchange, so each task sends at most row_count rows a call
        w = Window.partitionBy("source_id", "path").orderBy("row_no")
        cut = cut.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= row_count).drop("_n")
    return cut


def listed_tables(listing: DataFrame, max_tables: int | None = None) -> DataFrame:
    """All tables of each source's listing, or the first `max_tables` in listing order with their number.

    The rank filter is applied within each task first, so however long one source's
    listing is, at most `max_tables` of its rows leave a task.
    """
    tables = listing.select("source_id", "path", "row_no", F.col("wa").alias("table_name"))
    if max_tables is None:
        return tables
    w = Window.partitionBy("source_id").orderBy("path", "row_no")
    return tables.withColumn("table_no", F.row_number().over(w)).filter(F.col("table_no") <= max_tables)


def structure(body: Column | str) -> Column:
    """Field rows of an ABAP dictionary reply."""
    return F.from_json(body, _STRUCTURE)["FIELDS"]


def structure_fields(rows: Column, variant: str = "live") -> Column:
    return F.transform(
        rows,
        lambda f: field(
            F.coalesce(f["FIELDNAME"], F.lit("")),
            universal_type(F.coalesce(f["DATATYPE"], F.lit("C")), "abap", variant),
            F.coalesce(f["DATATYPE"], F.lit("")),
            primary_key=F.coalesce(f["KEYFLAG"], F.lit("")) == "X",
            description=F.coalesce(f["FIELDTEXT"], F.lit("")),
        ),
    )


def interface(body: Column | str) -> Column:
    """Parameter rows of a function interface reply."""
    return F.from_json(body, _INTERFACE)["PARAMS_AND_EXCPS"]


def interface_fields(rows: Column, variant: str = "live") -> Column:
    return F.transform(
        rows,
        lambda p: field(
            F.coalesce(p["PARAMETER"], F.lit("")),
            universal_type(F.coalesce(p["TABNAME"], F.lit("C")), "abap", variant),
            F.coalesce(p["TABNAME"], F.lit("")),
            description=F.coalesce(p["PARAMTEXT"], F.lit("")),
        ),
    )


def listing(body: Column | str) -> Column:
    """Stripped work areas of a table read, blank ones dropped."""
    areas = F.transform(F.from_json(body, _LISTING)["DATA"], lambda d: strip(d["WA"]))
    return F.filter(areas, lambda wa: wa != "")


def service_names(body: Column | str) -> Column:
    """Technical names that a gateway catalog lists."""
    listed = F.try_variant_get(F.try_parse_json(body), "$.value", "array<struct<TechnicalServiceName:string>>")
    return F.filter(F.transform(listed, lambda s: s["TechnicalServiceName"]), lambda n: non_empty(n).isNotNull())


def abap_fields(
    structures: DataFrame, tables: DataFrame | None = None, variant: str = "live"
) -> DataFrame:
    """Fields of ABAP tables; with `tables` (of `listed_tables`) only those are kept."""
    if tables is not None:
        wanted = tables.select("source_id", F.col("table_name").alias("entity_hint")).distinct()
        structures = structures.join(wanted, ["source_id", "entity_hint"], "left_semi")
    found = structures.select("source_id", "path", "entity_hint", structure("body").alias("_f"))
    described = F.concat(F.lit("Table SAP ABAP "), "entity_hint") if variant == "lib" else F.lit(None).cast("string")
    entities = found.select(
        "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"),
        F.lit("sap_table").alias("entity_type"), described.alias("entity_description"),
        structure_fields(F.col("_f"), variant).alias("fields"),
    )
    return explode_fields(entities, keep_empty=False)


def bapi_fields(interfaces: DataFrame, variant: str = "live") -> DataFrame:
    """Parameters of function modules; a module without parameters stays."""
    found = interfaces.filter(J.is_readable_object("body")).select(
        "source_id", "path", "entity_hint", F.from_json("body", _INTERFACE).alias("_d")
    )
    described = (
        F.concat(F.lit("BAPI/Function Module SAP "), "entity_hint") if variant == "lib"
        else F.lit(None).cast("string")
    )
    entities = found.select(
        "source_id", "path", F.lit(0).alias("entity_no"), F.col("entity_hint").alias("entity"),
        F.lit("sap_bapi").alias("entity_type"), described.alias("entity_description"),
        interface_fields(F.col("_d.PARAMS_AND_EXCPS"), variant).alias("fields"),
    )
    return explode_fields(entities, keep_empty=True)


def gateway_services(catalogs: DataFrame, max_services: int | None = None) -> DataFrame:
    """Named services of each source's gateway catalog, all or the first `max_services`, and how many there are.

    The pages of a catalog count as one listing, in page order. Refused requests list none.
    """
    if "status" in catalogs.columns:
        catalogs = catalogs.filter(F.coalesce("status", F.lit(200)) < 400)
    names = service_names("body")
    page = F.struct(first_page("path").alias("at"), page_number("path").alias("page"), F.col("_names").alias("names"))
    whole = catalogs.select("source_id", "path", names.alias("_names")).groupBy("source_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(page)), lambda p: p["names"])).alias("_names")
    )
    return whole.select(
        "source_id",
        F.size("_names").alias("n_services"),
        F.posexplode("_names" if max_services is None else F.slice("_names", 1, max_services)).alias("service_no", "service"),
    )


def service_fields(catalogs: DataFrame, metadata: DataFrame, max_services: int | None = None) -> DataFrame:
    """Fields of the catalogued services' metadata documents (`entity_hint` names the service).

    With several services the service name goes before the entity name. A source without
    a catalog is read as the one service it is.
    """
    services = gateway_services(catalogs, max_services)
    several = services.select(
        "source_id", F.col("service").alias("entity_hint"),
        F.when(F.col("n_services") > 1, F.col("service")).alias("prefix"),
    ).distinct()
    listed = metadata.join(several, ["source_id", "entity_hint"])
    alone = metadata.join(services.select("source_id").distinct(), "source_id", "left_anti").withColumn(
        "prefix", F.lit(None).cast("string")
    )
    return edmx_fields(listed.unionByName(alone), "sap", prefix="prefix")
