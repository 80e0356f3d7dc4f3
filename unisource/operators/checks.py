"""Rules a source must meet, and keys Spark does not enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.functions.text import non_empty
from unisource.schemas import CONNECTOR_CATEGORIES, MAX_LENGTHS

# ---- fixed values: messages of the rules ----
HOST_MISSING = "host est requis pour une connexion base de données"
DATABASE_MISSING = "database_name est requis pour une connexion base de données"
RFC_HOST_MISSING = "host est requis pour SAP RFC (ex: sap.company.com)"
URL_MISSING = "base_url est requis pour un web service"
NAME_LENGTH = "name must have 1 to 255 characters"
DEFAULT_CATEGORY = "database"


def category_of(connector_type: Column) -> Column:
    """Category of a connector type, null for an unknown one."""
    pairs = [F.lit(x) for category, names in CONNECTOR_CATEGORIES.items() for n in names for x in (n, category)]
    return F.try_element_at(F.create_map(*pairs), connector_type)


def categorise(sources: DataFrame) -> DataFrame:
    return sources.withColumn("category", F.coalesce(category_of(F.col("connector_type")), F.lit(DEFAULT_CATEGORY)))


def validate(sources: DataFrame) -> DataFrame:
    """Adds `errors`, the first unmet rule of the category and the name's length rule."""
    category = category_of(F.col("connector_type"))

    def missing(column: str) -> Column:
        return non_empty(column).isNull()

    required = (
        F.when((category == "database") & missing("host"), HOST_MISSING)
        .when((category == "database") & missing("database_name"), DATABASE_MISSING)
        .when((F.col("connector_type") == "sap_rfc") & missing("host"), RFC_HOST_MISSING)
        .when(
            (category == "webservice") & (F.col("connector_type") != "sap_rfc") & missing("base_url"), URL_MISSING
        )
    )
    length = F.coalesce(F.length("name"), F.lit(0))
    name = F.when(~length.between(1, 255), NAME_LENGTH)
    return sources.withColumn("errors", F.array_compact(F.array(name, required)))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; counted before the exchange."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent is not there."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def overlong(df: DataFrame, table: str) -> Column:
    """Whether a text of a catalog table's row is longer than its limit."""
    limits = [F.length(c) > n for c, n in MAX_LENGTHS[table].items() if c in df.columns]
    return F.coalesce(reduce(lambda a, b: a | b, limits, F.lit(False)), F.lit(False))


def catalog_integrity(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """How many violations of each catalog rule there are, from one scan of either table.

    A field sends one counter for its name and one for its position, combined within each task. Counters
    are summed per entity, and meet the entities as one row each.
    """
    long = overlong(fields, "fields").cast("long")
    cells = fields.select("entity_id", F.inline(F.array(
        F.struct(F.lit(True).alias("named"), F.col("name").alias("name"), F.lit(None).cast(fields.schema["position"].dataType).alias("position"), long.alias("long")),
        F.struct(F.lit(False).alias("named"), F.lit(None).cast("string").alias("name"), F.col("position").alias("position"), F.lit(0).cast("long").alias("long")),
    )))
    keys = cells.groupBy("entity_id", "named", "name", "position").agg(F.count("*").alias("n"), F.sum("long").alias("long"))
    own = keys.groupBy("entity_id").agg(
        F.count_if(F.col("named") & (F.col("n") > 1)).alias("names"), F.count_if(~F.col("named") & (F.col("n") > 1)).alias("positions"),
        F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("rows"), F.sum("long").alias("long"),
    )
    known = entities.groupBy("id").agg(F.sum(overlong(entities, "entities").cast("long")).alias("entity_long"), F.lit(True).alias("known"))
    met = own.join(known, own["entity_id"] == known["id"], "full")
    rules = {
        "field name unique in entity": F.sum("names"), "field position unique in entity": F.sum("positions"),
        "field has entity": F.sum(F.when(F.col("known").isNull(), F.col("rows"))), "entity text length": F.sum("entity_long"),
        "field text length": F.sum("long"),
    }
    totals = met.agg(*[F.coalesce(total, F.lit(0)).alias(f"r{i}") for i, total in enumerate(rules.values())])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, rule in enumerate(rules)])))
