"""Periodic runs against a search of every period at every place."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np

from unisource.llm import periodic
from unisource.llm.queries.models import op11_periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, k int, period string, START string, runs string, data string"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and smallest_period(words[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = np.random.default_rng(2)
    out = ["a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "b a b a b a b a c", "x " * 300, "a a b " * 40 + "a a c " * 40, "a b a b a a b a b a " * 9]
    for p in [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 100]:
        for exponent in (3.9, 4, 4.3, 9):
            block = [f"v{x}" for x in rng.integers(0, 3 * p, p)]
            head, tail = ([f"h{x}" for x in rng.integers(0, 9, int(rng.integers(0, 40)))] for _ in range(2))
            out.append(" ".join([*head, *(block[i % p] for i in range(int(exponent * p))), *tail]))
    for _ in range(150):
        out.append(" ".join(rng.choice(["a", "b"], int(rng.integers(1, 90))).tolist()))
    nested = " ".join("u v " * 8 + f"z{i % 3}" for i in range(30))
    return [*out, nested, nested + " " + nested]


def test_runs_of_texts(spark):
    texts = [None, "", " \n\t ", "one", "A a A a A a", "é\x1c é\x1c é\x1c é\x1c é\x1c é\x1c", *periodic_texts()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (None, "q " * 9), (9, "another text")]
    docs = spark.createDataFrame([(*r, 1, "p", "s", "r", "d") for r in rows], SCHEMA).repartition(4)
    got = [
        (r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed_sha256)
        for r in periodic.periodic_runs(docs).collect()
    ]
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        want.append((doc, len(words), tuple(runs), hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(len(w[2]) > 3 for w in want)
    assert periodic.periodic_runs(docs.where("doc_id < -1")).count() == 0


def test_tiles_cut_by_length(monkeypatch):
    """Runs over many tiles are stitched from their fragments, whatever a tile's length."""
    monkeypatch.setattr(periodic, "TILE_WORDS", 3)
    for text in periodic_texts():
        codes = periodic.codes_of(text.encode().split())
        joined = {}
        for tile in periodic.tiles(codes):
            for q, a, b in periodic.solve(*tile):
                joined.setdefault(q, set()).update(range(a, b))
        runs = []
        for q, places in joined.items():
            for s in sorted(places):
                if s - 1 not in places:
                    e = s
                    while e in places:
                        e += 1
                    if e - s + q >= max(6, 4 * q):
                        runs.append((s, e - s + q, q))
        assert sorted(runs, key=lambda r: (r[0], r[2])) == plain_runs(codes.tolist())


def test_query_plants_and_finds(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 400, int(rng.integers(0, 160))))) for i in range(400)] + [(401, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want[doc] = (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest(),
        )
    got = {
        r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        for r in op11_periodic_runs(spark, str(tmp_path)).collect()
    }
    assert got == want and sum(w[0] > 0 for w in want.values()) > 15
