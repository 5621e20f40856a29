"""Parts of the removal of repeated strings: packing, merged spans, dealt anchors, equal ids."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
from pairwell.llm import substrings as S


def test_packed_segments_come_back():
    draw = np.random.default_rng(1)
    n = 500
    anchor, seg = draw.integers(0, 1 << 48, n), draw.integers(-(1 << 63), 1 << 63, n)
    doc, kind = draw.integers(-5, 5, n), draw.integers(-(1 << 63), 1 << 63, n)
    pos, size = draw.integers(0, 1 << 31, n), draw.integers(50, 77, n)
    got = sorted(zip(*(c.tolist() for c in S.unpacked(S.packed(anchor, seg, doc, kind, pos, size))), strict=True))
    high = (seg.view(np.uint64) >> np.uint64(16)).view(np.int64)
    assert got == sorted(zip(*(c.tolist() for c in (anchor, high, doc, kind, pos, size)), strict=True))


def test_spans_that_touch_are_one():
    column = lambda *v: np.array(v, np.int64)
    doc, kind, span = S.merged(column(1, 1, 2, 1), column(0, 0, 0, 0), column(10, 60, 60, 130), column(50, 50, 50, 50))
    assert [(d, c // S.SPAN, c % S.SPAN) for d, c in zip(doc.tolist(), span.tolist(), strict=True)] == [(1, 10, 100), (1, 130, 50), (2, 60, 50)]


def test_dealt_anchors_give_all_strings():
    """A part of a frequent anchor tells every string with its smallest document, to be merged with other parts."""
    texts = [b"a" * 60, b"a" * 55 + b"bbbbb"]
    rows = list(zip([7, 7], [0, 0], [True, True], [3, 4], [0, 0], [5, 9], texts, strict=True))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list("abcdefg"))
    got = pa.Table.from_batches(S.found_in_blocks(iter([batch]))).to_pylist()
    assert len(got) == 22
    assert {(g["doc"], g["span"] // S.SPAN, g["least"]) for g in got} == {(3, 5 + i, 3) for i in range(11)} | {(4, 9 + i, 3 if i < 6 else 4) for i in range(11)}
    assert len({g["string"] for g in got}) == 1 + 5


def test_overlapping_passages_and_equal_ids(spark):
    """Passages that share only a part, texts of one id that differ, and a text that repeats itself."""
    draw = random.Random(5)
    words = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.choice('lmnrst')}" for _ in range(60)]
    base = " ".join(draw.choice(words) for _ in range(400))
    rows = []
    for d in range(120):
        at = draw.randrange(len(base) - 300)
        own = " ".join(f"{draw.choice(words)}{d}" for _ in range(draw.randrange(30)))
        rows.append((d, own + base[at : at + draw.randrange(40, 300)] * draw.choice((1, 1, 2)) + own[::-1]))
    schema = "doc_id long, text string"
    got = S.remove_repeats(spark.createDataFrame(rows, schema).repartition(7)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute.repeats(rows)))
    # The texts of one id take nothing from each other; those of a larger id lose what either has.
    alike = [(1, base[:200]), (1, base[100:300]), (2, base[:300])]
    got = S.remove_repeats(spark.createDataFrame(alike, schema)).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 200, 0), (1, 200, 0), (2, 300, 300)]
