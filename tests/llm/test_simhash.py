"""SimHash fingerprints and components against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from unisource.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, row long, FP string, part string, visit string"


def plain_fingerprint(text, size=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    smallest = {k: min((d for d, x in zip(ids, label) if x == k and d is not None), default=None) for k in set(label)}
    return [smallest[k] for k in label]


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " \t\n", "One", "one", "two WORDS", "a b c", "A B C", "é 中 😀 x", "x\x1cy z\x85 w", "w " * 40_000]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 60, 400)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base[:200], "other", *base[201:]]), " ".join(base).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "two WORDS"), (None, "a b c"), (None, "nobody else"), (7, "an id twice")]
    docs = spark.createDataFrame([(*r, 9, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    fps = [plain_fingerprint(t) for _, t in rows]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect())
    want = plain_components(fps, [d for d, _ in rows], 2)
    assert got == sorted((d if d is not None else -1, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want))
    assert simhash.near_copies(docs.where("doc_id < -1")).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want if c is not None})


@pytest.mark.parametrize("blocks", [4, 8, 16])
@pytest.mark.parametrize("tile_size", [3, 4096])
def test_tiles_lose_no_link(spark, blocks, tile_size):
    """Clusters that touch, chains of single bits, and random fingerprints, with tiles whole and cut."""
    rng = np.random.default_rng(blocks)
    fps = [0, (1 << 64) - 1, 1, 3, 7, 15, 31, 1 << 63, (1 << 64) - 2]
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        fps += [centre] + [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (25, 2))]
        fps += [centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for a, b, c, d in rng.integers(0, 64, (10, 4))]
    fps = list(dict.fromkeys(fps + rng.integers(0, 1 << 63, 60).tolist()))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    links = simhash.tile_links(classes, blocks, 2, tile_size)
    labels = {r.cid: r.label for r in simhash.spread_labels(links).collect()}
    want = plain_components(fps, signed, 2)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        assert {labels.get(f, f) for f in members} == {min(members)}


def test_every_pair_of_tiles_meets_once():
    steps = {tuple(s) for s in simhash.steps(4, 2).tolist()}
    assert len(steps) == 21 and (0, 0, 0, 0) in steps
    assert not any(tuple(-x for x in s) in steps for s in steps if any(s))
