"""Word hashes of texts as numpy arrays, for the operators that work on arrays inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit values that can be undone, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hashes of words as UTF-8 bytes, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class WordHasher:
    """64-bit hashes of a text's words; those of frequent words are looked up.

    Bytes know only the ASCII letters and white space, which is what a word is defined by.
    """

    def __init__(self, lower: bool):
        self.lower = lower
        self.cache = Hashes()

    def words(self, text: str | None) -> list[str]:
        text = text if isinstance(text, str) else ""
        return WORD.findall(text.translate(UPPER_TO_LOWER) if self.lower else text)

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        found = (data.lower() if self.lower else data).split()
        return np.fromiter(map(self.cache.__getitem__, found), np.uint64, len(found))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n if size else 0):
        out = out * MIX + hashes[k : k + size]
    return mixed(out)
