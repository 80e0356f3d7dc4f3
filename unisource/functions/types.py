"""Native type names of each dialect and the universal type vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unisource.functions.text import col, strip

# ---- fixed values: native name -> universal type, per dialect and variant ----
TYPE_MAPS: dict[tuple[str, str], dict[str, str]] = {
    ("sql", "live"): {
        "INTEGER": "integer",
        "BIGINT": "integer",
        "SMALLINT": "integer",
        "INT": "integer",
        "NUMERIC": "decimal",
        "DECIMAL": "decimal",
        "FLOAT": "float",
        "DOUBLE": "float",
        "REAL": "float",
        "VARCHAR": "string",
        "TEXT": "string",
        "CHAR": "string",
        "NVARCHAR": "string",
        "BOOLEAN": "boolean",
        "BOOL": "boolean",
        "DATE": "date",
        "TIMESTAMP": "datetime",
        "DATETIME": "datetime",
        "JSON": "json",
        "JSONB": "json",
        "UUID": "uuid",
    },
    ("sql", "lib"): {
        "INTEGER": "integer",
        "BIGINT": "integer",
        "SMALLINT": "integer",
        "NUMERIC": "decimal",
        "DECIMAL": "decimal",
        "FLOAT": "float",
        "DOUBLE": "float",
        "VARCHAR": "string",
        "TEXT": "string",
        "CHAR": "string",
        "NVARCHAR": "string",
        "BOOLEAN": "boolean",
        "BOOL": "boolean",
        "DATE": "date",
        "TIMESTAMP": "datetime",
        "DATETIME": "datetime",
        "TIME": "time",
        "JSON": "json",
        "JSONB": "json",
        "UUID": "uuid",
        "BYTEA": "binary",
        "BLOB": "binary",
    },
    ("sql", "sage100"): {
        "varchar": "string",
        "nvarchar": "string",
        "char": "string",
        "text": "string",
        "ntext": "string",
        "int": "integer",
        "bigint": "integer",
        "smallint": "integer",
        "tinyint": "integer",
        "bit": "boolean",
        "decimal": "decimal",
        "numeric": "decimal",
        "money": "decimal",
        "float": "float",
        "real": "float",
        "date": "date",
        "datetime": "datetime",
        "datetime2": "datetime",
    },
    ("edm", "live"): {
        "Edm.String": "string",
        "Edm.Binary": "string",
        "Edm.Time": "string",
        "Edm.Int16": "integer",
        "Edm.Int32": "integer",
        "Edm.Int64": "integer",
        "Edm.Byte": "integer",
        "Edm.Decimal": "decimal",
        "Edm.Single": "float",
        "Edm.Double": "float",
        "Edm.Boolean": "boolean",
        "Edm.DateTime": "datetime",
        "Edm.DateTimeOffset": "datetime",
        "Edm.Date": "date",
        "Edm.Guid": "uuid",
    },
    ("edm", "lib"): {
        "Edm.String": "string",
        "Edm.Int16": "integer",
        "Edm.Int32": "integer",
        "Edm.Int64": "integer",
        "Edm.Decimal": "decimal",
        "Edm.Single": "float",
        "Edm.Double": "float",
        "Edm.Boolean": "boolean",
        "Edm.DateTime": "datetime",
        "Edm.DateTimeOffset": "datetime",
        "Edm.Date": "date",
        "Edm.Time": "time",
        "Edm.TimeOfDay": "time",
        "Edm.Guid": "uuid",
        "Edm.Binary": "binary",
    },
    ("edm", "sap"): {
        "Edm.String": "string",
        "Edm.Binary": "string",
        "Edm.Int16": "integer",
        "Edm.Int32": "integer",
        "Edm.Int64": "integer",
        "Edm.Byte": "integer",
        "Edm.Decimal": "decimal",
        "Edm.Single": "float",
        "Edm.Double": "float",
        "Edm.Boolean": "boolean",
        "Edm.DateTime": "datetime",
        "Edm.DateTimeOffset": "datetime",
        "Edm.Date": "date",
        "Edm.Guid": "uuid",
    },
    ("edm", "dynamics"): {
        "Edm.String": "string",
        "Edm.Binary": "string",
        "Edm.Int16": "integer",
        "Edm.Int32": "integer",
        "Edm.Int64": "integer",
        "Edm.Decimal": "decimal",
        "Edm.Single": "float",
        "Edm.Double": "float",
        "Edm.Boolean": "boolean",
        "Edm.DateTime": "datetime",
        "Edm.DateTimeOffset": "datetime",
        "Edm.Date": "date",
        "Edm.Guid": "uuid",
    },
    ("dynamics", "live"): {
        "lookup": "uuid",
        "uniqueidentifier": "uuid",
        "owner": "uuid",
        "customer": "uuid",
        "picklist": "integer",
        "integer": "integer",
        "bigint": "integer",
        "state": "integer",
        "status": "integer",
        "boolean": "boolean",
        "decimal": "decimal",
        "money": "decimal",
        "double": "float",
        "datetime": "datetime",
        "memo": "string",
        "string": "string",
        "virtual": "string",
        "image": "string",
    },
    ("abap", "live"): {
        "C": "string",
        "N": "string",
        "T": "string",
        "X": "string",
        "STRING": "string",
        "CHAR": "string",
        "NUMC": "string",
        "D": "date",
        "DATS": "date",
        "I": "integer",
        "S": "integer",
        "B": "integer",
        "INT1": "integer",
        "INT2": "integer",
        "INT4": "integer",
        "P": "decimal",
        "CURR": "decimal",
        "QUAN": "decimal",
        "DEC": "decimal",
        "F": "float",
    },
    ("abap", "lib"): {
        "C": "string",
        "N": "string",
        "T": "string",
        "X": "string",
        "STRING": "string",
        "CHAR": "string",
        "NUMC": "string",
        "XSTRING": "string",
        "TIMS": "string",
        "D": "date",
        "DATS": "date",
        "I": "integer",
        "S": "integer",
        "B": "integer",
        "INT1": "integer",
        "INT2": "integer",
        "INT4": "integer",
        "INT8": "integer",
        "P": "decimal",
        "CURR": "decimal",
        "QUAN": "decimal",
        "DEC": "decimal",
        "F": "float",
    },
    ("sage_x3", "live"): {
        "A": "string",
        "ANM": "string",
        "M": "string",
        "C": "string",
        "D": "date",
        "DCB": "decimal",
        "MD": "decimal",
        "QTY": "decimal",
        "L": "integer",
        "W": "integer",
        "Y": "boolean",
    },
}

# ---- fixed values: universal type -> Spark type ----
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DecimalType(38, 18),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "time": T.StringType(),
    "json": T.VariantType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
    "object": T.VariantType(),
    "array": T.ArrayType(T.VariantType()),
}


def native_lookup(dialect: str, variant: str = "live") -> dict[str, str]:
    return TYPE_MAPS[(dialect, variant)]


def native_key(native: Column | str, dialect: Column, variant: Column) -> Column:
    """The form of a native name that its dialect's map is keyed by."""
    n = col(native)
    cut = strip(F.split_part(n, F.lit("("), F.lit(1)))
    return (
        F.when((dialect == "sql") & (variant == "sage100"), F.lower(cut))
        .when(dialect == "sql", F.upper(cut))
        .when(dialect == "dynamics", F.lower(n))
        .otherwise(n)
    )


def universal_type(native: Column | str, dialect: str, variant: str = "live") -> Column:
    """Look one dialect's names up without a join; unknown names are strings."""
    pairs = [F.lit(x) for item in native_lookup(dialect, variant).items() for x in item]
    key = native_key(native, F.lit(dialect), F.lit(variant))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit("string"))


def type_map(spark: SparkSession) -> DataFrame:
    """All maps as one small table; its size is fixed by the code above."""
    rows = [
        (dialect, variant, native, universal)
        for dialect, variant in TYPE_MAPS
        for native, universal in native_lookup(dialect, variant).items()
    ]
    return spark.createDataFrame(rows, "dialect string, variant string, native string, universal string")


def normalize_types(
    df: DataFrame, native: str = "native_type", dialect: str = "dialect", variant: str = "variant",
    output: str = "type",
) -> DataFrame:
    """Map native types of mixed dialects; the fixed-size type map is the broadcast side."""
    key = native_key(native, F.col(dialect), F.col(variant))
    known = type_map(df.sparkSession).select(
        F.col("dialect").alias("_d"), F.col("variant").alias("_v"), F.col("native").alias("_n"),
        F.col("universal").alias("_u"),
    )
    keyed = df.withColumn("_key", key)
    match = (
        (keyed[dialect] == known["_d"]) & (keyed[variant] == known["_v"]) & (keyed["_key"] == known["_n"])
    )
    return (
        keyed.join(F.broadcast(known), match, "left")
        .withColumn(output, F.coalesce("_u", F.lit("string")))
        .drop("_key", "_d", "_v", "_n", "_u")
    )


def to_spark_type(universal: str, native: str | None = None) -> T.DataType:
    """Spark type for reading a field; a decimal keeps the precision its native name shows."""
    if universal == "decimal" and native:
        size = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", native)
        if size and 1 <= int(size[1]) <= 38 and int(size[2] or 0) <= int(size[1]):
            return T.DecimalType(int(size[1]), int(size[2] or 0))
    return SPARK_TYPES.get(universal, T.StringType())


def struct_for(fields: Iterable[Mapping]) -> T.StructType:
    """Build a read schema from field descriptors; navigation fields carry no data."""
    ordered = sorted((f for f in fields if f["data_type"] != "relation"), key=lambda f: f["position"])
    return T.StructType(
        [
            T.StructField(f["name"], to_spark_type(f["data_type"], f.get("native_type")), f.get("is_nullable", True))
            for f in ordered
        ]
    )
