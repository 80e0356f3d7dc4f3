"""Random JSON bodies that are built together with the rows and fields they must give."""

import json
import random

from pyspark.sql import functions as F

from unisource.operators import records, sage

KEYS = ["id", "b", "z.y", "tax_id", "é", "a b", "k'q"]
FLAT = [
    (1, "integer"), (-7, "integer"), (0, "integer"), (10**25, "integer"), (2.5, "float"), (1.0, "float"), (1e5, "float"),
    (True, "boolean"), (False, "boolean"), (None, "string"), ("x", "string"), ("", "string"), ("[1]", "string"),
    ('{"a":1}', "string"), ("true", "string"), ("2024-01-02", "date"), ({"u": 1}, "object"), ({}, "object"),
]


def record(rng):
    """A record without lists and the fields it has."""
    chosen = [(k, *rng.choice(FLAT)) for k in rng.sample(KEYS, rng.randint(0, 4))]
    return {k: v for k, v, _ in chosen}, [(k, t) for k, _, t in chosen]


def said(records_, fields):
    return f"JSON - {records_} enregistrements, {fields} champs"


def cases(n):
    """(body, rows, endpoint fields or None for no entity, file fields, file description)."""
    rng = random.Random(11)
    for _ in range(n):
        one, own = record(rng)
        many = [record(rng) for _ in range(rng.randint(1, 3))]
        rows, first = [r for r, _ in many], many[0][1]
        outer = {**one, "rows": rows}
        shape = rng.randrange(7)
        if shape == 0:
            yield rows, rows, first, first, said(len(rows), len(first))
        elif shape == 1:
            yield one, [one], own, own, said(1, len(own))
        elif shape == 2:
            yield outer, rows, [*own, ("rows", "array")], first, said(len(rows), len(first))
        elif shape == 3:  # rows take an empty list, files go on to the next one
            yield {"none": [], **outer}, [], [("none", "array"), *own, ("rows", "array")], first, said(len(rows), len(first))
        elif shape == 4:
            yield [], [], [], [], said(0, 0)
        elif shape == 5:
            yield [3, "x"], [3, "x"], None, [], said(2, 0)
        else:
            yield rng.choice([3, "x", 2.5, True]), [], [], [], None


def by_path(df):
    found = {}
    for r in df.orderBy("path", "position").collect():
        found.setdefault(int(r["path"][1:]), []).extend([(r["name"], r["type"])] if r["position"] is not None else [])
    return found


def test_known_answers(land):
    known = list(cases(400))
    landed = land(*[("s", "e", json.dumps(body)) for body, *_ in known])

    rows = {}
    for r in records.rest_rows(landed).select("path", "row_no", F.to_json("row").alias("t")).collect():
        rows.setdefault(int(r["path"][1:]), {})[r["row_no"]] = json.loads(r["t"])
    for i, (body, expected, *_) in enumerate(known):
        assert [rows.get(i, {})[k] for k in sorted(rows.get(i, {}))] == expected, body

    assert by_path(records.endpoint_fields(landed)) == {i: k[2] for i, k in enumerate(known) if k[2] is not None}
    found = records.json_file_fields(landed)
    assert by_path(found) == {i: k[3] for i, k in enumerate(known)}
    texts = {int(r["path"][1:]): r["entity_description"] for r in found.select("path", "entity_description").distinct().collect()}
    assert texts == {i: k[4] for i, k in enumerate(known)}


def test_cloud_known_answers(land):
    rng = random.Random(12)
    known = []
    for _ in range(200):
        one, own = record(rng)
        known += rng.choice([
            [({"$items": [one, {}]}, own)],
            [({"value": [one]}, own)],
            [({"value": [], "$items": [one]}, own)],
            [({"$items": []}, [])],
            [({"$items": None, "value": [one]}, [])],
            [({"other": one}, [])],
            [({"$items": [5]}, [("id", "uuid"), ("display_name", "string")])],
        ])
    got = by_path(sage.cloud_fields(land(*[("s", "e", json.dumps(body)) for body, _ in known])))
    assert got == {i: fields for i, (_, fields) in enumerate(known)}
