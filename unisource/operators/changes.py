"""Catalog changes as joins and unions: the new state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unisource.operators.checks import categorise, validate

# Columns an update may set; the rest of a source row is kept by the engine.
UPDATABLE = [
    "name", "description", "host", "port", "database_name", "schema_name", "base_url", "auth_type",
    "username", "options", "tags",
]


def metadata_replace(current: DataFrame, synced: DataFrame, found: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows after the sources in `synced` got `found` as their whole metadata.

    A synced source that found nothing ends up without rows.
    """
    kept = current.join(synced.select(key).distinct(), key, "left_anti")
    return kept.unionByName(found.join(synced.select(key).distinct(), key, "left_semi"))


def _given(column: str, value: Column) -> Column:
    """A patch value that counts as given: an empty options object does not."""
    if column == "options":
        return F.when(~value.isin("", "{}"), value)
    return value


def partial_update(current: DataFrame, patches: DataFrame, columns: list[str] | None = None, key: str = "id", order_by: str | None = None) -> DataFrame:
    """Set only what a patch gives; a row whose patch gives nothing is unchanged.

    Several patches of one row count as one: of each column the latest given value by `order_by`. Without it
    they must not contradict each other, else the query fails. `updated_at` moves where something was set.
    """
    columns = [c for c in (columns or UPDATABLE) if c in current.columns and c in patches.columns]

    def settled(c: str) -> Column:
        value = _given(c, F.col(c))
        if order_by:
            return F.max_by(value, F.when(value.isNotNull(), F.col(order_by)))
        apart = F.min(value) != F.max(value)
        return F.when(apart, F.raise_error(F.lit(f"patches of one row contradict each other in {c}"))).otherwise(F.max(value))

    patch = patches.groupBy(key).agg(*[settled(c).alias(f"_new_{c}") for c in columns])
    joined = current.join(patch, key, "left")
    changed = F.array_contains(F.array(*[F.col(f"_new_{c}").isNotNull() for c in columns]), True)
    result = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    if "updated_at" in current.columns:
        result = result.withColumn("updated_at", F.when(changed, F.current_timestamp()).otherwise(F.col("updated_at")))
    return result.select(*current.columns)


def new_sources(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted source rows with their defaults, and the refused requests with their errors."""
    checked = validate(requests)
    accepted = categorise(checked.filter(F.size("errors") == 0))
    now = F.current_timestamp()

    def given(column: str, default: Column) -> Column:
        return F.coalesce(column, default) if column in requests.columns else default

    rows = accepted.select(
        given("id", F.uuid()).alias("id"),
        "name",
        given("description", F.lit(None).cast("string")).alias("description"),
        "category",
        "connector_type",
        F.lit("pending").alias("status"),
        "host",
        given("port", F.lit(None).cast("int")).alias("port"),
        "database_name",
        given("schema_name", F.lit(None).cast("string")).alias("schema_name"),
        "base_url",
        given("auth_type", F.lit("none")).alias("auth_type"),
        given("username", F.lit(None).cast("string")).alias("username"),
        given("options", F.lit("{}")).alias("options"),
        given("tags", F.array().cast("array<string>")).alias("tags"),
        F.lit(0).alias("entity_count"),
        F.lit(None).cast("int").alias("test_latency_ms"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("last_tested_at"),
        F.lit(None).cast("timestamp").alias("last_synced_at"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return rows, checked.filter(F.size("errors") > 0)


def upsert_latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Insert or overwrite by key: the row with the highest version stays.

    A maximum per key, combined before the exchange, so a key written very often stays cheap.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def cascade_delete(
    doomed: DataFrame, sources: DataFrame, entities: DataFrame, fields: DataFrame,
    tests: DataFrame | None = None, relations: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every table without the doomed sources (`id`) and what hangs on them.

    `deleted` lists the sources that were there.
    """
    ids = doomed.select("id").distinct()
    owners = ids.withColumnRenamed("id", "source_id")
    gone = entities.join(owners, "source_id", "left_semi").select(F.col("id").alias("entity_id"))
    state = {
        "sources": sources.join(ids, "id", "left_anti"),
        "entities": entities.join(owners, "source_id", "left_anti"),
        "fields": fields.join(gone, "entity_id", "left_anti"),
        "deleted": sources.join(ids, "id", "left_semi").select("id"),
    }
    if tests is not None:
        state["connection_tests"] = tests.join(owners, "source_id", "left_anti")
    if relations is not None:
        state["relations"] = (
            relations.join(owners, "source_id", "left_anti")
            .join(gone.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_anti")
            .join(gone.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_anti")
            .select(*relations.columns)
        )
    return state
