"""Catalog reads: filtered lists, pages with totals, and entities with their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unisource.session import staged

# ---- fixed values: page bounds ----
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200

# Fields nested into one row; a longer entity goes on in its next part.
FIELDS_PER_PART = 1000

_ROW_BITS = 33


def _contains(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{text}%")


def list_sources(
    sources: DataFrame, category: str | None = None, status: str | None = None, search: str | None = None
) -> DataFrame:
    """Sources that meet every given condition, newest first.

    The search text is a pattern: % and _ in it match like wildcards.
    """
    if category:
        sources = sources.filter(F.col("category") == category)
    if status:
        sources = sources.filter(F.col("status") == status)
    if search:
        sources = sources.filter(_contains("name", search) | _contains("description", search))
    return sources.orderBy(F.desc("created_at"), "id")


def get_source(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.filter(F.col("id") == source_id)


def visible_entities(entities: DataFrame, source_id: str | None = None, search: str = "") -> DataFrame:
    if source_id is not None:
        entities = entities.filter(F.col("source_id") == source_id)
    entities = entities.filter(F.col("is_visible"))
    # the unset search still asks for a name: ILIKE '%' drops null names
    return entities.filter(_contains("name", search) if search else F.col("name").isNotNull())


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def entity_page(
    entities: DataFrame, source_id: str | None = None, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
    search: str = "", deep: bool = False,
) -> DataFrame:
    """One page of visible entities by name; the id orders equal names.

    Each task keeps the rows up to the page's end. For a page far behind, ask for `deep`: see `deep_page`. The stored
    catalog finds any page by its files' counts (`Catalog.entity_page`).
    """
    check_page(page, page_size)
    found = visible_entities(entities, source_id, search)
    offset = (page - 1) * page_size
    if deep:
        return deep_page(found, ["name", "id"], offset, page_size)
    return found.orderBy("name", "id").offset(offset).limit(page_size)


def entity_page_after(
    entities: DataFrame, last_name: str, last_id: str, source_id: str | None = None,
    page_size: int = DEFAULT_PAGE_SIZE, search: str = "",
) -> DataFrame:
    """The page behind a known row: as cheap on the last page as on the first."""
    check_page(1, page_size)
    found = visible_entities(entities, source_id, search)
    behind = (F.col("name") > last_name) | ((F.col("name") == last_name) & (F.col("id") > last_id))
    return found.filter(behind).orderBy("name", "id").limit(page_size)


def deep_page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of a total order without one task seeing all rows before them.

    Rows are range-sorted once and staged; every row's rank is the number of rows in the
    ranges before it plus its place in its own range.
    """
    placed = staged(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id()),
        "page",
    )
    part = F.shiftright("_seq", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per range: this unpartitioned window sees as many rows as there are partitions.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_seq").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn("_rank", rank)
        .filter((F.col("_rank") >= offset) & (F.col("_rank") < offset + limit))
        .select(*df.columns)
        .orderBy(*order)
    )


def page_totals(
    entities: DataFrame, source_id: str | None = None, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
    search: str = "",
) -> DataFrame:
    """Totals under the page's own filter; a page past the end still has them."""
    check_page(page, page_size)
    total = F.col("total_entities")
    return (
        visible_entities(entities, source_id, search)
        .agg(F.count("*").alias("total_entities"))
        .select(
            F.lit(page).cast("bigint").alias("page"),
            F.lit(page_size).cast("bigint").alias("page_size"),
            "total_entities",
            F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("bigint").alias("total_pages"),
            F.lit(search).alias("search"),
        )
    )


def page_fields(fields: DataFrame, page: DataFrame) -> DataFrame:
    """Fields of the entities on one page. Spark knows a limited page is small and broadcasts it."""
    ids = page.select(F.col("id").alias("entity_id"))
    return fields.join(ids, "entity_id", "left_semi").orderBy("entity_id", "position", "name")


def entity_detail(entities: DataFrame, fields: DataFrame, per_part: int = FIELDS_PER_PART) -> DataFrame:
    """Entities with their ordered fields nested, and their whole field count.

    Positions are unique within an entity, so a range of `per_part` positions bounds every
    nested list: an entity with very many fields continues in parts 1, 2, ... Usual entities
    have part 0 only. Without fields the list is empty.

    Entities and parts meet on (entity, part). So fields are exchanged once, and the parts
    of one huge entity spread over the cluster. A missing position counts as 0, the catalog's default.
    """
    fields = fields.withColumn("position", F.coalesce("position", F.lit(0)))
    nested = fields.groupBy("entity_id", F.floor(F.col("position") / per_part).cast("int").alias("part")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "position", "name", "display_name", "data_type", "native_type", "is_nullable",
                    "is_primary_key", "is_foreign_key",
                )
            )
        ).alias("fields")
    )
    # counted from the bare keys, combined on the map side
    counts = fields.groupBy("entity_id").agg(
        F.count("*").alias("field_count"), F.floor(F.max("position") / per_part).cast("int").alias("_last")
    )
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))).alias("part")
    return (
        entities.withColumnRenamed("id", "entity_id")
        .join(counts, "entity_id", "left")
        .select("*", parts)
        .join(nested, ["entity_id", "part"], "left")
        # merging repeated names leaves gaps in the positions, perhaps a whole part long
        .filter((F.col("part") == 0) | F.col("fields").isNotNull())
        .withColumn("field_count", F.coalesce("field_count", F.lit(0)))
        .withColumn("fields", F.coalesce("fields", F.array().cast(nested.schema["fields"].dataType)))
        .drop("_last")
    )
