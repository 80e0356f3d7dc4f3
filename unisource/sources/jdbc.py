"""Database dictionaries and tables through Spark's JDBC reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns, primary keys and foreign keys of each database, in the shape the dictionary
# operators take. Type names are the short standard ones the type maps know.
_STANDARD_COLUMNS = """
SELECT table_name, column_name,
       CASE WHEN data_type LIKE 'timestamp%' THEN 'TIMESTAMP'
            WHEN data_type = 'character varying' THEN 'VARCHAR'
            WHEN data_type = 'character' THEN 'CHAR'
            ELSE data_type END AS native_type,
       CASE WHEN is_nullable = 'YES' THEN 1 ELSE 0 END AS nullable,
       ordinal_position - 1 AS position
FROM information_schema.columns WHERE table_schema = '{schema}'
"""
_STANDARD_KEYS = """
SELECT k.table_name, k.column_name
FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k
  ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name
WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = '{schema}'
"""
_STANDARD_REFERENCES = """
SELECT k.table_name, k.constraint_name, k.ordinal_position, k.column_name,
       u.table_name AS referred_table, u.column_name AS referred_column
FROM information_schema.referential_constraints r
JOIN information_schema.key_column_usage k
  ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema
JOIN information_schema.key_column_usage u
  ON u.constraint_name = r.unique_constraint_name AND u.constraint_schema = r.unique_constraint_schema
 AND u.ordinal_position = k.ordinal_position
WHERE k.table_schema = '{schema}'
"""
_MYSQL_REFERENCES = """
SELECT table_name, constraint_name, ordinal_position, column_name,
       referenced_table_name AS referred_table, referenced_column_name AS referred_column
FROM information_schema.key_column_usage
WHERE referenced_table_name IS NOT NULL AND table_schema = '{schema}'
"""
_STANDARD = {"columns": _STANDARD_COLUMNS, "primary_keys": _STANDARD_KEYS, "references": _STANDARD_REFERENCES}
DICTIONARY_SQL = {
    "postgresql": _STANDARD,
    "mssql": _STANDARD,
    "mysql": {**_STANDARD, "references": _MYSQL_REFERENCES},
    "sage_100": _STANDARD,
    "sqlite": {
        "columns": """
SELECT m.name AS table_name, p.name AS column_name, p.type AS native_type,
       1 - p."notnull" AS nullable, p.cid AS position
FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table'
""",
        "primary_keys": """
SELECT m.name AS table_name, p.name AS column_name
FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table' AND p.pk > 0
""",
        "references": """
SELECT m.name AS table_name, f.id AS constraint_name, f.seq AS ordinal_position, f."from" AS column_name,
       f."table" AS referred_table, f."to" AS referred_column
FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE m.type = 'table'
""",
    },
    "sap_hana": {
        "columns": """
SELECT table_name, column_name, data_type_name AS native_type,
       CASE WHEN is_nullable = 'TRUE' THEN 1 ELSE 0 END AS nullable, position - 1 AS position
FROM sys.table_columns WHERE schema_name = '{schema}'
""",
        "primary_keys": """
SELECT table_name, column_name FROM sys.constraints
WHERE is_primary_key = 'TRUE' AND schema_name = '{schema}'
""",
        "references": """
SELECT table_name, constraint_name, position AS ordinal_position, column_name,
       referenced_table_name AS referred_table, referenced_column_name AS referred_column
FROM sys.referential_constraints WHERE schema_name = '{schema}'
""",
    },
}


def dictionary_query(database: str, part: str, schema: str = "public") -> str:
    """Text of one dictionary query; quotes in the schema name are doubled."""
    return DICTIONARY_SQL[database][part].replace("{schema}", schema.replace("'", "''")).strip()


def read_dictionary(
    spark: SparkSession, database: str, options: dict[str, str], source_id: str, schema: str = "public"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, primary keys and foreign keys of one database."""

    def load(part: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(**options)
        df = reader.option("query", dictionary_query(database, part, schema)).load()
        return df.toDF(*[c.lower() for c in df.columns]).withColumn("source_id", F.lit(source_id))

    columns = load("columns").withColumn("nullable", F.col("nullable").cast("int") == 1)
    return columns, load("primary_keys"), group_references(load("references"))


def group_references(references: DataFrame) -> DataFrame:
    """Foreign keys with their column lists in constraint order (a handful of columns each)."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "referred_column")))
    return (
        references.groupBy("source_id", "table_name", "constraint_name", "referred_table")
        .agg(pairs.alias("_p"))
        .select(
            "source_id", "table_name",
            F.transform("_p", lambda p: p["column_name"]).alias("constrained"),
            "referred_table",
            F.transform("_p", lambda p: p["referred_column"]).alias("referred"),
        )
    )


def read_table(
    spark: SparkSession, options: dict[str, str], table: str, partition_column: str | None = None,
    bounds: tuple[str, str] | None = None, num_partitions: int | None = None,
) -> DataFrame:
    """A remote table; with a numeric or date column and its bounds it is read in parallel.

    Filters, columns and limits of queries over it are pushed to the database by Spark.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        if not (bounds and num_partitions):
            raise ValueError("a partition column needs its bounds and a number of partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=num_partitions,
        )
    return reader.load()


def registered_columns(spark: SparkSession, source_id: str, tables: list[str]) -> DataFrame:
    """Dictionary columns of tables and views the session already knows."""
    rows = [
        (source_id, table, c.name, c.dataType, c.nullable, i)
        for table in tables
        for i, c in enumerate(spark.catalog.listColumns(table))
    ]
    return spark.createDataFrame(
        rows,
        "source_id string, table_name string, column_name string, native_type string, nullable boolean, position int",
    )
