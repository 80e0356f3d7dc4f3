import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from unisource.operators.records import json_file_fields
from unisource.operators.summary import csv_summary
from unisource.sources import files

# Per case: the file, its description, and name and type of each column.
CSV_CASES = {
    "plain": ("a,b\n1,2024-01-01\n22,2024-01-02\n", "CSV - 2 lignes, 2 colonnes", [("a", "integer"), ("b", "date")]),
    "bom": ("\ufeffa,b\n1,x\n", "CSV - 1 lignes, 2 colonnes", [("a", "boolean"), ("b", "string")]),
    "quoted newline": ('a,b\n"x\ny",12\n"q""q",13\n', "CSV - 2 lignes, 2 colonnes", [("a", "string"), ("b", "integer")]),
    "blank lines": ("a,b\n\n1,2\n\n\n3,4\n", "CSV - 2 lignes, 2 colonnes", [("a", "integer"), ("b", "integer")]),
    "short and long rows": ("a,b,c\n1\n2,3,4,5\n6,7,8\n", "CSV - 3 lignes, 3 colonnes", [("a", "integer"), ("b", "integer"), ("c", "integer")]),
    "header only": ("a,b\n", None, []),
    "padded header": (" a , b b \n1,2\n", "CSV - 1 lignes, 2 colonnes", [("a", "boolean"), ("b b", "integer")]),
    "duplicate header": ("a,b,a\n1,x,2024-01-01\n2,y,2024-01-02\n", "CSV - 2 lignes, 3 colonnes", [("a", "date"), ("b", "string"), ("a", "date")]),
    "case duplicate header": ("a,A\n1.5,x\n", "CSV - 1 lignes, 2 colonnes", [("a", "float"), ("A", "string")]),
    "backslashes": ('a,b\nC:\\x,"d\\"\n', "CSV - 1 lignes, 2 colonnes", [("a", "string"), ("b", "string")]),
    "crlf": ("a,b\r\n12,1.5\r\n13,2.5\r\n", "CSV - 2 lignes, 2 colonnes", [("a", "integer"), ("b", "float")]),
    "blank-only line": ("a\n5\n   \n7\n", "CSV - 3 lignes, 1 colonnes", [("a", "string")]),
    "one column quotes": ('a\n"x, y"\n"z"\n', "CSV - 2 lignes, 1 colonnes", [("a", "string")]),
    "quote inside": ('a,b\n5" pipe,7\n', "CSV - 1 lignes, 2 colonnes", [("a", "string"), ("b", "integer")]),
}


@pytest.mark.parametrize("case", CSV_CASES)
def test_csv_fields(spark, tmp_path, case):
    path = tmp_path / "x.csv"
    content, description, expected = CSV_CASES[case]
    path.write_bytes(content.encode("utf-8"))
    for sample in (100, None):
        got = files.csv_fields(spark, str(path), "x", sample=sample).orderBy("position").collect()
        assert {r["entity_description"] for r in got} == {description}
        assert [(r["name"], r["type"]) for r in got if r["position"] is not None] == expected


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id, v ,id\n1,"a\nb",9\n2,,8\n')
    assert [r.asDict() for r in files.read_csv(spark, str(path)).rows().collect()] == [
        {"id": "9", "v": "a\nb"}, {"id": "8", "v": None}
    ]


def test_csv_sample_is_the_first_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a\n" + "12\n" * 100 + "x\n" * 400)
    assert files.csv_fields(spark, str(path), "x", sample=100).first()["type"] == "integer"
    assert files.csv_fields(spark, str(path), "x").first()["type"] == "string"  # all rows vote unless a sample is asked for


def test_only_needed_files_go_another_way(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n"x, y",1\n')
    (folder / "b.csv").write_text('a,b\n"x\ny",2\n')
    (folder / "c.csv").write_text("a,b\n  \n")
    flags = {r.file[-5:]: (r.spans, r.broken, r.header) for r in files.file_flags(spark, str(folder)).collect()}
    assert flags == {"a.csv": (False, False, "a,b"), "b.csv": (True, False, "a,b"), "c.csv": (True, False, "a,b")}
    got = files.read_csv(spark, str(folder)).rows().collect()
    assert sorted(tuple(r) for r in got if r["b"]) == [("x\ny", "2"), ("x, y", "1")]
    assert [r["a"] for r in got if r["b"] is None] == ["  "]


def test_very_many_spanning_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a\n"x\n{i}"\n')
    assert sorted(r["a"] for r in files.read_csv(spark, str(tmp_path)).rows().collect()) == ["x\n0", "x\n1", "x\n2"]


def test_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_csv(spark, str(tmp_path))


def test_json_file(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("﻿" + json.dumps({"e": [], "rows": [{"z": 1, "a": "2024-01-01"}, {"z": 2}]}, indent=1), encoding="utf-8")
    got = json_file_fields(files.land_files(spark, str(path), "s", "my_file")).orderBy("position").collect()
    assert [(r["entity"], r["name"], r["type"], r["entity_description"]) for r in got] == [
        ("my_file", "z", "integer", "JSON - 2 enregistrements, 2 champs"), ("my_file", "a", "date", "JSON - 2 enregistrements, 2 champs")
    ]


@pytest.mark.parametrize(
    "kind,content,expected",
    [("file_csv", "{", "csv"), ("file_json", "a,b", "json"), ("file_excel", "\n  \n [1]", "json"), ("file_excel", ' {"a":1}', "json"),
     ("file_excel", "a,b\n1,2", "csv"), ("file_excel", "", "csv")],
)
def test_format_choice(spark, tmp_path, kind, content, expected):
    path = tmp_path / "x"
    path.write_text(content)
    assert files.file_format(spark, str(path), kind) == expected


def test_decoding(spark):
    df = spark.createDataFrame([("é".encode("utf-8"),), ("é".encode("latin-1"),), (b"\xef\xbb\xbfa",)], "c binary")
    assert [r[0] for r in df.select(files.decode_preview(F.col("c"))).collect()] == ["é", "é", "﻿a"]
    good = df.filter(F.length("c") != 1)
    assert [r[0] for r in good.select(files.decode_sync(F.col("c"))).collect()] == ["é", "a"]
    with pytest.raises(PySparkException):
        df.select(files.decode_sync(F.col("c"))).collect()


def test_previews_and_uploads(spark, tmp_path, land):
    df = spark.range(20).select(F.col("id").alias("a"))
    assert [r["a"] for r in files.preview_head(df, ["a"]).collect()] == [0, 1, 2, 3, 4]
    got = files.preview_json(land(('[{"b":1,"a":2},{"c":1},3,4,5,6,7]',), ('{"rows":[{"x":1}]}',), ("[]",))).orderBy("path").collect()
    assert [(r["columns"], r["column_count"]) for r in got] == [(["b", "a"], 2), (["rows"], 1), ([], 0)]
    assert [len(r["preview"]) for r in got] == [5, 1, 0]
    (tmp_path / "a.csv").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("x")
    assert [(r["filename"], r["size"]) for r in files.list_uploads(spark, str(tmp_path)).collect()] == [("a.csv", 5)]


def test_summary(spark):
    df = spark.createDataFrame([("1", "2")] * 3, "a string, b string")
    assert csv_summary(df, "x").first()["description"] == "CSV - 3 lignes, 2 colonnes"
    empty = csv_summary(df.limit(0), "x").first()
    assert (empty["n_fields"], empty["description"]) == (0, None)


def test_invalid_bytes_fail_a_sync_but_not_a_preview(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("nom,n\né,1\n".encode("latin-1"))
    with pytest.raises(ValueError):
        files.csv_fields(spark, str(path), "x")
    about, preview = files.preview_upload(spark, str(path))
    assert [tuple(r) for r in preview.collect()] == [("é", "1")]
    row = about.first()
    assert (row["filename"], row["size"], row["format"], row["columns"], row["column_count"]) == ("latin.csv", 10, "csv", ["nom", "n"], 2)


def test_upload_previews(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,b\n" + "1,2\n" * 9)
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "a.json").write_text('[{"x":1,"y":2},{"x":3}]')
    (tmp_path / "o.json").write_text('{"rows":[{"x":1}],"n":1}')
    seen = {}
    for name in ("a.txt", "empty.csv", "a.json", "o.json"):
        about, preview = files.preview_upload(spark, str(tmp_path / name))
        seen[name] = (about.first()["format"], about.first()["columns"], preview.count())
    assert seen == {
        "a.txt": ("csv", ["a", "b"], 5), "empty.csv": ("csv", [], 0), "a.json": ("json", ["x", "y"], 2), "o.json": ("json", ["rows", "n"], 1),
    }
    with pytest.raises(ValueError):
        files.preview_upload(spark, str(tmp_path / "a.xls"))


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2.5}\n')
    landed = files.land_lines(spark, str(tmp_path / "x.jsonl"), "s", "e")
    assert sorted(r["body"] for r in landed.collect()) == ['{"a":1}', '{"a":2.5}']
