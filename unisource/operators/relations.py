"""Relations between entities: declared by keys, or measured in the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fk_relations(foreign_keys: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys column by column, where the referred table is listed too.

    Pairs end with the shorter of the two column lists.
    """
    known = tables.select("source_id", F.col("table_name").alias("referred_table")).distinct()
    pairs = F.arrays_zip(F.col("constrained").alias("c"), F.col("referred").alias("r"))
    return (
        foreign_keys.join(known, ["source_id", "referred_table"], "left_semi")
        .select("source_id", "table_name", "referred_table", F.explode(pairs).alias("_p"))
        .filter(F.col("_p.c").isNotNull() & F.col("_p.r").isNotNull())
        .select(
            "source_id",
            F.col("table_name").alias("source_entity"),
            F.col("referred_table").alias("target_entity"),
            F.col("_p.c").alias("source_field"),
            F.col("_p.r").alias("target_field"),
            F.lit("many_to_one").alias("relation_type"),
        )
    )


def to_relations(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Catalog rows of relations, their entity names looked up among a source's entities.

    Names may repeat within a source; a relation then belongs to the smallest id.
    """
    ids = entities.groupBy("source_id", "name").agg(F.min("id").alias("_id"))
    own = ids.select("source_id", F.col("name").alias("source_entity"), F.col("_id").alias("source_entity_id"))
    other = ids.select("source_id", F.col("name").alias("target_entity"), F.col("_id").alias("target_entity_id"))
    parts = ["source_id", "source_entity", "target_entity", "source_field", "target_field"]
    measured = "confidence" in found.columns
    return (
        found.join(own, ["source_id", "source_entity"])
        .join(other, ["source_id", "target_entity"], "left")
        .select(
            F.md5(F.concat_ws("\x1f", *parts)).alias("id"), "source_id", "source_entity_id", "target_entity_id",
            "source_field", "target_field", "relation_type",
            (F.col("confidence") if measured else F.lit(1.0)).alias("confidence"),
            F.lit(False).alias("is_confirmed"),
        )
    )


def _key_stem(column: str) -> str:
    """What a key column is about: its name without the table's own short prefix."""
    return column.split("_", 1)[1] if "_" in column else column


def key_candidates(tables: dict[str, DataFrame], primary_keys: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """Column pairs worth measuring, from names and types alone: no data is read."""
    found = []
    for source, df in tables.items():
        types = dict(df.dtypes)
        for column in df.columns:
            if not column.lower().endswith(("key", "_id")):
                continue
            for target, key in primary_keys.items():
                same_type = types[column] == dict(tables[target].dtypes)[key]
                if (source, column) != (target, key) and same_type and _key_stem(column) == _key_stem(key):
                    found.append((source, column, target, key))
    return found


def containment(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Share of a column's distinct values that occur in the key column.

    Both sides shrink to distinct values on the map side and are exchanged once by value;
    the join finds them already placed. One value held by most rows is one row here.
    """
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    keys = target.select(F.col(key).alias("v")).filter(F.col("v").isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return values.join(keys, "v", "left").agg(
        F.count("*").alias("n_values"), F.count("_hit").alias("n_found")
    )


Pair = tuple[str, str, str, str]
Place = tuple[str, str]  # table and column
_BITS = 62  # columns per word of a mask
# A theta sketch of 2^12 entries: four standard errors of its estimates, relative to what the union of two holds.
_SKETCH_ENTRIES = 12
_SKETCH_ERROR = 4 / (1 << _SKETCH_ENTRIES) ** 0.5


def _places(pairs: list[Pair]) -> dict[Place, int]:
    """A number for each column that occurs in a pair."""
    return {p: i for i, p in enumerate(dict.fromkeys(x for s, c, t, k in pairs for x in ((s, c), (t, k))))}


def _own(places: dict[Place, int], table: str) -> dict[str, int]:
    return {c: i for (t, c), i in places.items() if t == table}


def sketched_pairs(tables: dict[str, DataFrame], pairs: list[Pair], least: float) -> list[Pair]:
    """The pairs whose containment may reach `least`, by theta sketches of all their columns: one pass a table.

    A pair goes only if its estimate, four standard errors better, stays below. Columns of types without sketches
    stay. The sketches meet on Spark; only the names of the remaining pairs come back.
    """
    places = _places(pairs)
    sketchable = {"int", "bigint", "float", "double", "string"}
    drawn = []
    for name, df in tables.items():
        own = {c: i for c, i in _own(places, name).items() if dict(df.dtypes)[c] in sketchable}
        if own:
            row = df.agg(*[F.theta_sketch_agg(c, _SKETCH_ENTRIES).alias(f"c{i}") for c, i in own.items()])
            drawn.append(row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"c{i}").alias("sketch")) for i in own.values()]))))
    if not drawn:
        return pairs
    spark = next(iter(tables.values())).sparkSession
    asked = spark.createDataFrame([(n, places[s, c], places[t, k]) for n, (s, c, t, k) in enumerate(pairs)], "pair int, source int, target int")
    sketches = reduce(DataFrame.unionByName, drawn)
    left, right = (sketches.select(F.col("place").alias(end), F.col("sketch").alias(f"{end}_sketch")) for end in ("source", "target"))
    both, either = F.theta_intersection("source_sketch", "target_sketch"), F.theta_union("source_sketch", "target_sketch")
    estimates = [F.theta_sketch_estimate(x).cast("double").alias(n) for x, n in ((both, "both"), (either, "either"), (F.col("source_sketch"), "own"))]
    met = asked.join(left, "source").join(right, "target").select("pair", *estimates)
    hopeless = met.filter((F.col("both") + _SKETCH_ERROR * F.col("either") < least * F.col("own") * (1 - _SKETCH_ERROR)))
    gone = {r["pair"] for r in hopeless.select("pair").collect()}
    return [p for n, p in enumerate(pairs) if n not in gone]


def shared_values(tables: dict[str, DataFrame], places: dict[Place, int]) -> DataFrame:
    """Words w0, w1, ... of masks and n: how many distinct values occur in exactly the columns of the mask.

    Every table is read once, whatever number of its columns are asked for. A value sends one row per task, however often it
    occurs, and is exchanged once with the columns that hold it.
    """
    words = [f"w{i}" for i in range(max(places.values()) // _BITS + 1)]
    types = sorted({dict(tables[t].dtypes)[c] for t, c in places})
    parts = []
    for name, df in tables.items():
        cells = []
        for c, i in _own(places, name).items():
            kind = dict(df.dtypes)[c]
            value = [(F.col(c) if t == kind else F.lit(None).cast(t)).alias(f"v{k}") for k, t in enumerate(types)]
            mask = [F.lit(1 << (i % _BITS) if i // _BITS == k else 0).cast("bigint").alias(w) for k, w in enumerate(words)]
            cells.append(F.struct(*value, *mask, F.col(c).isNotNull().alias("filled")))
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).filter("filled").drop("filled"))
    values = reduce(DataFrame.unionByName, parts)
    masks = values.groupBy(*[f"v{k}" for k in range(len(types))]).agg(*[F.bit_or(w).alias(w) for w in words])
    return masks.groupBy(*words).agg(F.count("*").alias("n"))


def relation_confidence(tables: dict[str, DataFrame], primary_keys: dict[str, str], least: float | None = None) -> DataFrame:
    """Relations by containment of key-like columns, unconfirmed, with exact counts of distinct values.

    All pairs, or those of a containment of `least` at least; then sketches leave out beforehand what cannot reach it.
    """
    pairs = key_candidates(tables, primary_keys)
    if not pairs:
        raise ValueError("no column looks like a key of another table")
    if least is not None:
        pairs = sketched_pairs(tables, pairs, least)
    spark = next(iter(tables.values())).sparkSession
    schema = "source_entity string, source_field string, target_entity string, target_field string"
    if not pairs:
        empty = spark.createDataFrame([], schema)
        counts = empty.select("*", F.lit(0).cast("bigint").alias("n_values"), F.lit(0).cast("bigint").alias("n_found"))
    else:
        places = _places(pairs)

        def has(place: Place) -> Column:
            word, bit = divmod(places[place], _BITS)
            return F.col(f"w{word}").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

        tested = F.array(*[
            F.struct(F.lit(n).alias("pair"), has((s, c)).alias("own"), has((t, k)).alias("other")) for n, (s, c, t, k) in enumerate(pairs)
        ])
        own = shared_values(tables, places).select("n", F.inline(tested)).filter("own")
        measured = own.groupBy("pair").agg(F.sum("n").alias("n_values"), F.sum(F.when(F.col("other"), F.col("n")).otherwise(0)).alias("n_found"))
        named = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], f"pair int, {schema}")
        counts = named.join(measured, "pair", "left").fillna(0, ["n_values", "n_found"])
    share = F.coalesce(F.try_divide(F.col("n_found").cast("double"), F.col("n_values").cast("double")), F.lit(0.0))
    found = counts.select(
        "source_entity", "source_field", "target_entity", "target_field", F.lit("many_to_one").alias("relation_type"),
        "n_values", "n_found", share.alias("confidence"), F.lit(False).alias("is_confirmed"),
    )
    return found if least is None else found.filter(F.col("confidence") >= least)
