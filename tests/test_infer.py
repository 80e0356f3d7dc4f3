import random

import pytest

from unisource.operators.infer import infer_columns, vote


def voted(spark, columns):
    cells = [(name, v) for name, values in columns.items() for v in values]
    df = spark.createDataFrame(cells, "name string, value string")
    return {r["name"]: r["type"] for r in vote(df, ["name"]).collect()}


CASES = {
    "exactly 80 %": (["1", "22", "33", "44", "x"], "string"),
    "81 %": (["22"] * 81 + ["x"] * 19, "integer"),
    "bits": (["0", "1"] * 5, "boolean"),
    "half floats": (["2", "2.5"] * 5, "string"),
    "timestamps": (["2024-01-02 03:04:05", "2024-01-02T03:04"], "date"),
    "blank cells count": (["22"] * 4 + ["   "], "string"),
    "empty cells do not": (["22"] * 4 + ["", None], "integer"),
    "all empty": (["", None], "string"),
    "padded": (["\t12 ", "\u00a013\u2003", "\x1c14\x1f"], "integer"),
    "no number forms": (["1e5", "+3", ".5", "1,5", "5."], "string"),
    "words": (["oui", "NON", "True", "false"], "boolean"),
    "negative floats": (["-1.5", "2.25"], "float"),
    "other digits": (["١٢", "３４"], "integer"),
    "date too short": (["2024-1-02"], "string"),
    "padded words": ([" Oui ", "\tnon"], "boolean"),
    "inner newline": (["12\n34"], "string"),
    "trailing newline": (["12\n"], "integer"),
}


def test_vote_cases(spark):
    got = voted(spark, {name: values for name, (values, _) in CASES.items()})
    assert got == {name: expected for name, (_, expected) in CASES.items()}


CELLS = {
    "date": ["2024-05-06", "2024-05-06T01", " 1999-12-31 "],
    "integer": ["12", "-7", "12\t", "３４"],
    "float": ["3.5", "-0.25", "\u00a02.5"],
    "boolean": ["oui", "Non", "TRUE", "0", "1"],
    "string": ["x", " ", "1.", "é", "2024-5-6", "--1", "1-1"],
}


def test_vote_needs_more_than_four_fifths(spark):
    """Columns are dealt with a known share of one kind of cells; empty ones do not count."""
    rng = random.Random(7)
    columns, expected = {}, {}
    for i in range(300):
        kind = rng.choice(list(CELLS))
        size, odd = rng.choice([(10, 0), (10, 1), (10, 2), (10, 5), (100, 19), (100, 20), (1, 0)])
        cells = [rng.choice(CELLS[kind]) for _ in range(size - odd)] + [rng.choice(["x", "é", "1-1"]) for _ in range(odd)]
        cells += [rng.choice(["", None]) for _ in range(rng.randint(0, 20))]
        rng.shuffle(cells)
        columns[f"c{i}"] = cells
        expected[f"c{i}"] = kind if 5 * odd < size else "string"
    assert voted(spark, columns) == expected


def test_merge_numeric(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("3",), ("4.5",)], "c string")
    assert infer_columns(df).first()["type"] == "string"
    assert infer_columns(df, merge_numeric=True).first()["type"] == "float"


def test_sample_needs_order(spark):
    df = spark.createDataFrame([(i, "7" if i < 100 else "x") for i in range(1000)], "id int, c string")
    with pytest.raises(ValueError):
        infer_columns(df, sample=100)
    sampled = {r["name"]: r["type"] for r in infer_columns(df, sample=100, order_by=["id"]).collect()}
    assert sampled["c"] == "integer"
    assert {r["name"]: r["type"] for r in infer_columns(df).collect()}["c"] == "string"


def test_names_with_dots_and_positions(spark):
    df = spark.createDataFrame([("1", "a")], "`x.y` string, ` z ` string")
    assert [(r["position"], r["name"]) for r in infer_columns(df).orderBy("position").collect()] == [(0, "x.y"), (1, "z")]
