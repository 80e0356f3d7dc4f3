"""Collocations against plain counting of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from unisource.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, f long, k string, phrase string"


def plain(rows, least, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    part = p[i : i + size]
                    inside[part] = max(inside[part], c)
        found = []
        for p, a in often.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(4)
    vocabulary = ["the", "of", "a", "New", "york", "é", "中", "x\x1cy", "b\x01", "b", "b!c", "in,to", "\x85", *[f"w{i}" for i in range(60)]]
    rows = []
    for i in range(260):
        words = [vocabulary[int(x)] for x in rng.zipf(1.4, int(rng.integers(0, 120))) % len(vocabulary)]
        if i % 3 == 0:
            words[5:5] = ["as", "a", "matter", "of", "fact"]
        if i % 4 == 0:
            words += ["Hot", "dog\tstand.", "hot dog"]
        rows.append((["en", "fr", None, "und"][int(rng.integers(0, 4))], " ".join(words)))
    rows += [("en", None), ("en", ""), (None, " \n."), ("fr", "one"), *rows[:4]]
    rows.append(("en", "long tail of words " * 3000))
    return rows


@pytest.mark.parametrize(("range_bytes", "shard_words", "least", "top"), [(1 << 30, 1 << 20, 30, 2000), (900, 700, 5, 2000), (900, 50, 12, 7)])
def test_collocations(spark, monkeypatch, range_bytes, shard_words, least, top):
    """One range and one shard, and very many of both, with phrases on their borders."""
    monkeypatch.setattr(phrases, "HELD_BYTES", 2000)
    rows = texts()
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "k", "p") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    got = phrases.collocations(docs, least, top, range_bytes, shard_words)
    want = plain(rows, least, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10
    assert phrases.collocations(docs.where("doc_id < 0"), least, top).count() == 0


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Scores and shares of counts whose products pass 64 bits."""
    big = 3_000_000_000_000_007
    counts = {("a",): big + 5, ("b",): big + 1, ("c",): big, ("a", "b"): big, ("b", "c"): big - 1, ("a", "b", "c"): big * 8 // 10}
    rows = [("en", " ".join(p), f) for p, f in counts.items()] + [("en", None, 9 * big)]
    monkeypatch.setattr(phrases, "range_counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, f long"))
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs).collect()}
    assert got == {  # floor(8/10) of the longer phrase is below four fifths of "a b", and four fifths of "b c" or more
        "a b": (big, big + 5, big + 1, 9 * big, 2000000 * big // (2 * big + 6)),
        "a b c": (big * 8 // 10, big + 5, big - 1, 9 * big, 2000000 * (big * 8 // 10) // (2 * big + 4)),
    }


def test_automaton_round_trip():
    rng = np.random.default_rng(8)
    words = sorted(f"w{i}".encode() for i in range(9))
    rows = rng.integers(0, 9, (500, 4)).astype(np.int32)
    for d in range(1, 4):
        rows[rng.random(500) < 0.2, d:] = -1
    want = Counter(tuple(int(x) for x in r[:d]) for r in rows for d in range(1, 5) if r[d - 1] >= 0)
    halves = [phrases.build(words, phrases.levels_of_windows(*phrases.summed(half, np.ones(len(half), np.int64)))) for half in (rows[:200], rows[200:])]
    whole = phrases.united([phrases.dump(a) for a in halves])
    found, weights = whole.phrases()
    assert {tuple(x for x in r.tolist() if x >= 0): w for r, w in zip(found, weights.tolist())} == want
    asked = [*(tuple(words[i] for i in p) for p in want), (b"w0", b"none"), (b"none",), tuple([words[0]] * 4)]
    answers = whole.compose(whole.rows_of(asked))
    assert answers.tolist() == [want.get(tuple(words.index(w) if w in words else -9 for w in p), 0) for p in asked]
    assert len(whole.label[3]) < sum(len(p) == 4 for p in want)  # equal states are one
