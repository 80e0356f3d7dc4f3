import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unisource import session
from unisource.functions import text, types


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_display_name_is_title_case(spark):
    names = ["o_orderkey", "l2x", "o'neil", "éa_ab", "ABC_def", "日a", "straße", "x__y", "", "ßa", "a1b2_C3"]
    assert apply(spark, names, text.display_name) == [n.replace("_", " ").title() for n in names]


def test_strip_matches_python(spark):
    spaces = "".join(chr(i) for i in range(0xD800) if chr(i).isspace())
    values = [f"{c}a b{c}" for c in spaces] + ["\u200bx\u200b", spaces]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_entity_names(spark):
    assert apply(spark, ["My Data  Set"], text.entity_name_from_source) == ["my_data__set"]
    paths = ["/users/", "/a/b/", "/", "", "x"]
    assert apply(spark, paths, text.entity_name_from_path) == ["users", "a/b", "data", "data", "x"]
    assert apply(spark, paths, lambda c: text.entity_name_from_path(c, True)) == ["users", "a_b", "data", "data", "x"]


SIZES = {
    0: "0.0 o", 1: "1.0 o", 1023: "1023.0 o", 1024: "1.0 Ko", 1280: "1.2 Ko", 1792: "1.8 Ko", 1536: "1.5 Ko",
    1048575: "1024.0 Ko", 1048576: "1.0 Mo", 5368709121: "5.0 Go", 1099511627776: "1.0 To", 3377699720527872: "3072.0 To",
}


def test_human_size(spark):
    assert apply(spark, list(map(str, SIZES)), lambda c: text.human_size(c.cast("bigint"))) == list(SIZES.values())


@pytest.mark.parametrize(
    "file_path,uploaded,url,expected",
    [
        ("C:\\Users\\a.csv", None, None, "/mnt/host/Users/a.csv"),
        ("\\\\srv\\share\\a.csv", None, None, "/mnt/network/srv/share/a.csv"),
        ("//srv/share/a.csv", None, None, "/mnt/network/srv/share/a.csv"),
        ("/data/a.csv", "/up", None, "/data/a.csv"),
        ("C:", None, None, "C:"),
        ("", "/up/a.csv", "http://u", "/up/a.csv"),
        (None, "", "http://u", "http://u"),
        (None, None, None, ""),
    ],
)
def test_resolve_path(spark, file_path, uploaded, url, expected):
    df = spark.createDataFrame([(file_path, uploaded, url)], "f string, u string, b string")
    assert df.select(text.resolve_path("f", "u", "b")).first()[0] == expected


@pytest.mark.parametrize(
    "dialect,variant,native,expected",
    [
        ("sql", "live", "VARCHAR(255)", "string"), ("sql", "live", "numeric(12, 2)", "decimal"),
        ("sql", "live", "DOUBLE PRECISION", "string"), ("sql", "live", "TINYINT", "string"),
        ("sql", "live", "BIT", "string"), ("sql", "live", "MONEY", "string"), ("sql", "live", "DATETIME2", "string"),
        ("edm", "live", "Edm.SByte", "string"), ("edm", "live", "Edm.Time", "string"), ("edm", "lib", "Edm.Time", "time"),
        ("abap", "live", "INT8", "string"), ("abap", "lib", "INT8", "integer"), ("sage_x3", "live", "Y", "boolean"),
        ("dynamics", "live", "MEMO", "string"), ("sql", "sage100", "Bit", "boolean"), ("sql", "live", None, "string"),
    ],
)
def test_universal_type(spark, dialect, variant, native, expected):
    assert apply(spark, [native], lambda c: types.universal_type(c, dialect, variant)) == [expected]


def test_spark_types():
    assert types.to_spark_type("decimal", "NUMERIC(12, 2)") == T.DecimalType(12, 2)
    assert types.to_spark_type("decimal") == T.DecimalType(38, 18)
    assert types.to_spark_type("integer") == T.LongType()
    assert types.to_spark_type("unheard of") == T.StringType()
    fields = [
        {"name": "b", "data_type": "date", "position": 1}, {"name": "a", "data_type": "integer", "position": 0},
        {"name": "owner", "data_type": "relation", "position": 2},
    ]
    assert types.struct_for(fields) == T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DateType())])


def test_prefixes(spark):
    df = spark.createDataFrame([("f_doc",), ("X_F_",), ("CBF_x",), ("FACT",)], "n string")
    some = df.filter(text.starts_with_any("n", ["F_", "cbf_"])).collect()
    assert [r["n"] for r in some] == ["f_doc", "CBF_x"]
    assert df.filter(text.starts_with_any("n", [])).count() == 4


def test_spread_parts_are_bounded(spark, tmp_path, monkeypatch):
    """Parts get no larger with the input, also beyond the number of cores."""
    spark.range(200_000).select(F.xxhash64("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "PART_BYTES", 64 << 10, raising=False)
    stored = spark.read.parquet(str(tmp_path / "t"))
    spread = session.spread_small(stored)
    assert spread.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert spread.count() == 200_000


def test_spread_leaves_unknown_sizes(spark):
    """A table without statistics counts as 8 EiB, by which nothing can be split."""
    made = spark.createDataFrame([(1, "a")], "k long, v string")
    assert session.spread_small(made) is made
    assert session.spread_small(made.select("k")).count() == 1
