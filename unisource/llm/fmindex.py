"""A compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word, one count a word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts occurrences of word sequences of up to `depth` words.

    `text` holds small integers and ends with a 0, which no pattern holds; suffixes are sorted by their first `depth` symbols at least, which is all
    that patterns of that length can tell apart.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while reach < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
            reach *= 2
        last = text[order - 1]  # the symbol before each suffix; before the first stands the last
        self.length = n
        self.depth = depth
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        counts = np.bincount(text, minlength=1)
        # where suffixes that begin with a symbol start, less where its own descent begins
        self.first = np.cumsum(counts) - counts
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(n - bit.sum())))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        symbols = np.arange(len(counts))
        self.first -= self.descend(symbols, np.zeros(len(symbols), np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def occurs_again(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """For each start in `text` whether the `length` words from there occur at least twice in the index.

        Backward search of all starts at once, last word first. A start whose interval shrinks to one
        suffix has reached the end of its match and leaves.
        """
        found = np.zeros(len(starts), bool)
        active = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.length)
        for step in range(length - 1, -1, -1):
            symbol = text[starts[active] + step]
            first = self.first[symbol]
            low = first + self.descend(symbol, low)
            high = first + self.descend(symbol, high)
            more = high - low >= 2
            active, low, high = active[more], low[more], high[more]
        found[active] = True
        return found
