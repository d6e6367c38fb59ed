"""Runs of words of many texts are mixed together: the same sets as text by text."""

import random

import numpy as np
import xxhash

from blogindex.llm import jaccard

MASK = 2 ** 64 - 1


def _set(text, n, factors):
    """One text, one run at a time."""
    words = [xxhash.xxh64_intdigest(w) for w in (text or b"").lower().split()]
    width, out = min(n, len(words)), set()
    for at in range(len(words) - width + 1 if words else 0):
        mixed = width
        for i in range(width):
            x = words[at + i] * int(factors[i]) & MASK
            mixed += x ^ x >> 31
        mixed = (mixed & MASK ^ (mixed & MASK) >> 30) * 0xBF58476D1CE4E5B9 & MASK
        mixed = (mixed ^ mixed >> 27) * 0x94D049BB133111EB & MASK
        out.add(mixed ^ mixed >> 31)
    return sorted(out)


def test_sets_of_many_texts_are_those_of_each():
    """Null, empty, short and repeating texts; and few steps over arrays, however many texts there are."""
    rng = random.Random(4)
    texts = [None, b"", b" \t", b"a", b"A b"] + [" ".join(rng.choices("abcd", k=rng.randrange(0, 30))).encode() for _ in range(200)]
    for n in (1, 3, 5):
        make, calls = jaccard.Shingler(n), []
        real = make._mixed
        make._mixed = lambda h, width: (calls.append(width), real(h, width))[1]
        got = make(texts)
        assert [s.tolist() for s in got] == [_set(t, n, make.factors) for t in texts]
        assert calls.count(n) == 1
        hashes, sizes = make.all(texts)
        assert len(hashes) == sizes.sum() and set(hashes.tolist()) == {x for s in got for x in s.tolist()}
    assert make([]) == [] and all(s.dtype == np.uint64 for s in got)
