"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

A text is cut where a word begins (no piece of the vocabulary goes across such a place). All words a
batch has not seen before lie one after another in one array of symbols. In each round every word merges
its own lowest-ranked pair, its first occurrence, all words at once; a word is done when none of its pairs is a
piece. What is left are its tokens. Merging one occurrence a round keeps the library's order also
where a merge makes a pair of lower rank.

A long word (a text without spaces is one) would take as many rounds as it has tokens, so its places are kept by
rank: a round takes all places of its lowest rank at once and looks only at their neighbours again. Where a
merge makes a pair of lower rank, the round ends behind it, which keeps the library's order there too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

META = "▁"  # stands for a space
#: Counts of words kept by a task between batches; beyond that it starts anew. Longer words are not kept.
CACHE_WORDS = 200_000
CACHE_CHARS = 64
#: Words of more symbols are merged by themselves, by ranks.
LONG_SYMBOLS = 256


class PieceCounter:
    """Counts for one vocabulary: pieces with scores, byte pieces for all characters it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        scores = {}
        for i in range(library.vocab_size()):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)):
                piece = library.id_to_piece(i)
                self.ids[piece] = len(self.ids)
                scores[piece] = library.get_score(i)
        if any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("the vocabulary has pieces that go across a word's beginning")
        order = sorted(self.ids, key=lambda p: -scores[p])
        rank = {p: k for k, p in enumerate(order)}
        # all ways to put a piece together from two pieces
        pairs = [
            (self.ids[p[:k]], self.ids[p[k:]], rank[p], self.ids[p])
            for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        ]
        table = np.array(sorted((a * len(self.ids) + b, r, c) for a, b, r, c in pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0], table[:, 1], table[:, 2]
        self.none = len(self.ids)  # rank of a pair that is no piece
        self.cache: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbouring symbols; symbols under 0 are bytes and never merge."""
        if not len(self.keys):
            return np.full(len(left), self.none), np.full(len(left), -1)
        key = np.where((left >= 0) & (right >= 0), left * len(self.ids) + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        is_pair = self.keys[at] == key
        return np.where(is_pair, self.ranks[at], self.none), np.where(is_pair, self.merged[at], -1)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        symbols, lengths = [], []
        result = np.zeros(len(words), np.int64)
        for word in words:
            before = len(symbols)
            for c in word:
                i = self.ids.get(c)
                if i is None:
                    symbols.extend([-1] * len(c.encode()))  # one byte piece for each byte
                else:
                    symbols.append(i)
            size = len(symbols) - before
            if size > LONG_SYMBOLS:
                result[len(lengths)] = self.count_long(np.array(symbols[before:], np.int64))
                del symbols[before:]
                size = 0
            lengths.append(size)
        sym = np.array(symbols, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        while len(sym):
            rank, merged = self.pair_ranks(sym[:-1], sym[1:])
            rank[word[:-1] != word[1:]] = self.none
            rank, merged = np.append(rank, self.none), np.append(merged, -1)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            done = lowest == self.none
            result[word[first[done]]] = sizes[done]
            spread = np.repeat(lowest, sizes)
            hit = np.flatnonzero((rank == spread) & (spread < self.none))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit
            sym[hit] = merged[hit]
            keep = ~np.repeat(done, sizes)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        return result

    def count_long(self, sym: np.ndarray) -> int:
        """Tokens of one long word; a round costs what it merges, not the length of the word."""
        n = len(sym)
        sym = np.append(sym, -1)  # place n is behind the end; it makes no pair
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, self.none)
        merged = np.full(n + 1, -1)
        rank[: n - 1], merged[: n - 1] = self.pair_ranks(sym[: n - 1], sym[1:n])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < self.none]
            places = places[np.argsort(rank[places], kind="stable")]
            own = rank[places]
            border = np.flatnonzero(own[1:] != own[:-1]) + 1
            for start, end in zip([0, *border.tolist()], [*border.tolist(), len(own)]):
                if start < end:
                    r = int(own[start])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(places[start:end])

        wait(np.arange(n))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            all_ = np.unique(np.concatenate(waiting.pop(r)))
            all_ = all_[rank[all_] == r]
            if not len(all_):
                continue
            # of places that overlap the first, the third, ... are merged
            apart = np.append(True, after[all_[:-1]] != all_[1:])
            run = np.flatnonzero(apart)
            p = all_[(np.arange(len(all_)) - np.repeat(run, np.diff(np.append(run, len(all_))))) % 2 == 0]
            new, second = merged[p], after[p]
            right = after[second]
            # the left neighbour as it is by then: merged itself if the place before ends there
            other = np.where(before[p] >= 0, sym[before[p]], -1)
            joins = np.append(False, second[:-1] == before[p[1:]])
            other[joins] = new[np.flatnonzero(joins) - 1]
            lower = (self.pair_ranks(other, new)[0] < r) | (self.pair_ranks(new, sym[right])[0] < r)
            if lower.any():
                end = int(lower.argmax()) + 1
                rest = all_[all_ > p[end - 1]]
                p, new, second, right = p[:end], new[:end], second[:end], right[:end]
            else:
                rest = all_[:0]
            sym[p], after[p], before[right] = new, right, p
            rank[second] = self.none
            left -= len(p)
            touched = np.append(p, before[p][before[p] >= 0])
            touched = np.unique(touched)
            ends = after[touched]
            rank[touched], merged[touched] = self.pair_ranks(sym[touched], np.where(ends < n, sym[ends], -1))
            wait(np.append(touched, rest[rank[rest] == r]))
        return left

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        split = [pieces(t) if t else [] for t in texts]
        words = set().union(*split)
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = list(words)
        self.cache.update(zip(new, self.count_words(new).tolist()))
        counts = [sum(map(self.cache.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
        return counts


def pieces(text: str) -> list[str]:
    """A text's words, each with the marks for the spaces before it."""
    marked = (META + text).replace(" ", META)
    if META * 2 not in marked and not marked.endswith(META):
        return [META + w for w in marked[1:].split(META)]
    out, start = [], 0
    for k in range(1, len(marked)):
        if marked[k] == META and marked[k - 1] != META:
            out.append(marked[start:k])
            start = k
    out.append(marked[start:])
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


#: Texts handled at once within a batch, by characters.
SLICE_CHARS = 2_000_000


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, in one pass without an exchange.

    `vocabulary` is the path of a piece vocabulary on every executor. Null and empty texts have no bytes
    and no tokens; repeated rows are counted each; an empty table gives no rows. Words are counted once a
    task, as far as its cache goes; a text is never cut short.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            tokens: list[int] = []
            start = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE_CHARS or k == len(texts) - 1:
                    tokens += own.count(texts[start : k + 1])
                    start, size = k + 1, 0
            counts = np.array(tokens, np.int64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": counts, "over_limit": counts > limit,
            })

    return docs.select("doc_id", "text").mapInPandas(run, schema)
