"""Records that span lines, found from splits of any size, against one reader of the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from unisource.sources import csv_records, files


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that a record lies in many of them."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def table(seed, rows):
    """Cells with line breaks, quotes, commas and blanks, written by a CSV writer."""
    rng = random.Random(seed)
    parts = ["x", "é", ",", '"', "\n", "\n\n", " ", '""', "long text of a cell", ",\n", '"\n"']
    cells = [["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(3)] for _ in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows([["a", "b", "c"], *cells])
    return out.getvalue(), sorted(tuple(r) for r in cells)


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_any_split_gives_the_same_rows(spark, tmp_path, small_splits, size):
    want = []
    for seed in range(4):
        text, cells = table(seed, 25)
        (tmp_path / f"{seed}.csv").write_bytes(text.encode())
        want += cells
    small_splits(size)
    read = files.read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in read.rows().collect()) == sorted(want)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    text, cells = table(9, 200)
    (tmp_path / "one.csv").write_bytes(text.encode())
    small_splits(500)
    lines = csv_records.file_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    assert csv_records.records(lines).count() == len(cells) + 1


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [("a,b", False, True), ('"a', True, False), ('"a"', False, False), ('a"', False, False), ('5" pipe,7', False, False), ("", False, True),
     ('"a""', True, False), ('"a"","', False, True), ('a,"b', True, False), ('"a" x,"b', True, True), ('""', False, True), ('"', True, False), ('x","y', True, True)],
)
def test_a_line_is_a_map(spark, line, outside, inside):
    df = spark.createDataFrame([(line,)], "line string")
    assert tuple(df.select(csv_records.ends_inside(F.col("line"), False), csv_records.ends_inside(F.col("line"), True)).first()) == (outside, inside)


def test_a_quote_left_open_ends_with_the_file(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n3,"open\n4,5\n6,7\n')
    small_splits(6)
    got = csv_records.records(csv_records.file_lines(spark, str(tmp_path))).orderBy("block", "no").collect()
    assert [r.record for r in got] == ["a,b", "1,2", '3,"open\n4,5\n6,7']


def test_no_python_and_light_exchange(spark, tmp_path, plan):
    (tmp_path / "x.csv").write_text('a\n"x\ny"\n')
    text = plan(files.read_csv(spark, str(tmp_path)).data)
    assert "Python" not in text and "CartesianProduct" not in text
