"""Word hashes of odd texts."""

import pytest
import xxhash

from unisource.llm.arrays import WordHasher


@pytest.mark.parametrize("lower", [True, False])
def test_hashes_are_those_of_the_words(lower):
    text = " \x1c\x85 AB ab\x0bÄßİ\u2003x\n\r y\x00Z\x1f\ud800 \tAB "
    hasher = WordHasher(lower)
    expected = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in hasher.words(text)]
    assert hasher(text).tolist() == expected
    assert len(expected) == 6  # an em space divides nothing


@pytest.mark.parametrize("text", [None, "", " \n\t", float("nan")])
def test_no_words(text):
    assert len(WordHasher(True)(text)) == 0
