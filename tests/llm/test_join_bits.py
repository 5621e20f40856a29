"""Bits of shingle sets: never above the symmetric difference, and enough to keep unlinked shingles from being moved."""

import random

import numpy as np

from pairwell.llm import ngram_join
from pairwell.llm.ngram_join import Join, bits_of, places_apart


def test_bits_are_a_bound(monkeypatch):
    draw = np.random.default_rng(5)
    for most in (ngram_join.MOST_BITS, 256):
        monkeypatch.setattr(ngram_join, "MOST_BITS", most)
        for n in (1, 2, 17, 64, 300, 1000):
            for share in (0.0, 0.5, 0.9, 1.0):
                left = draw.integers(0, 1 << 63, n, np.uint64)
                kept = left[: int(n * share)]
                right = np.concatenate([kept, draw.integers(0, 1 << 63, max(1, n // 3), np.uint64)])
                low = places_apart(bits_of(left), bits_of(right))
                assert low == places_apart(bits_of(right), bits_of(left)) <= len(np.setxor1d(left, right))
    assert places_apart(bits_of(left), bits_of(left)) == 0


def test_shingles_of_unlinked_pairs_stay(spark, monkeypatch):
    """Texts of two that share half of their words meet in the lists, but only those near a link are compared by their shingles."""
    draw = random.Random(7)
    words = lambda: " ".join(f"w{draw.randrange(10**9)}" for _ in range(60))
    shared = [words() for _ in range(40)]
    rows = [(d, f"{words()} {shared[d // 2]}") for d in range(80)]
    rows += [(100 + d, text + " more") for d, (_, text) in enumerate(rows[:5])]
    met, asked = [], []
    bounds, overlaps = Join.bounds, Join.overlaps
    monkeypatch.setattr(Join, "bounds", lambda join, pairs: met.append(pairs.count()) or bounds(join, pairs))
    monkeypatch.setattr(Join, "overlaps", lambda join, pairs: asked.append(pairs.count()) or overlaps(join, pairs))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.shingle_components(docs).collect()}
    assert got == {d: d - 100 if d >= 100 else d for d, _ in rows}
    assert sum(met) >= 40
    assert sum(asked) <= 10
