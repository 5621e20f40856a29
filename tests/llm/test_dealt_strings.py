"""Strings of an anchor that is dealt over several blocks: few rows leave a task, with the same spans."""

from __future__ import annotations

import random

import brute
import pyarrow as pa
from pairwell.llm import substrings as S

KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def block(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=list("abcdefg"))


def test_strings_of_parts_meet_in_buckets():
    """Two parts of a dealt anchor: what a part can tell goes there, the rest is told by the other part; a bucket is a row."""
    draw = random.Random(3)
    common = bytes(draw.choices(range(97, 123), k=45))
    docs = [bytes(draw.choices(range(97, 123), k=10)) + common + bytes(draw.choices(range(97, 123), k=15)) for _ in range(300)]
    texts = dict(enumerate(docs + docs[100:200] + [d[5:] for d in docs[200:300]]))
    parts = [block([(7, p, True, d, 0, 0, t) for d, t in texts.items() if d % 3 % 2 == p]) for p in (0, 1)]
    found = [pa.Table.from_batches(S.settled_in_task(4)(iter([part]))).to_pylist() for part in parts]
    assert all(sum(r["strings"] is not None for r in rows) <= 4 for rows in found)
    assert sum(map(len, found)) < len(texts)
    rows = sorted(((r["bucket"], r["strings"]) for part in found for r in part if r["strings"]), key=lambda r: r[0])
    rest = S.settled_strings(iter([pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary())], names=["bucket", "strings"])]))
    spans = [r for part in found for r in part if r["strings"] is None] + [r for batch in rest for r in batch.to_pylist()]
    got = {d: set() for d in texts}
    for r in spans:
        start, size = divmod(r["span"], S.SPAN)
        got[r["doc"]] |= set(range(start, start + size))
    seen, want = set(), {}
    for d, t in texts.items():
        own = {i: t[i : i + S.LENGTH] for i in range(len(t) - S.LENGTH + 1)}
        want[d] = {b for i, s in own.items() if s in seen for b in range(i, i + S.LENGTH)}
        seen |= set(own.values())
    assert got == want


def test_anchor_of_many_texts(spark, monkeypatch):
    """A passage in more texts than a block takes, with other words around: the blocks make rows by spans, not by strings."""
    draw = random.Random(9)
    other = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    common = other(48)
    texts = [other(12) + common + other(14) for _ in range(S.BLOCK_SEGMENTS + 6000)]
    texts += [t[3:-3] for t in texts[-300:]] + texts[:200]
    rows = list(enumerate(texts))
    made = []
    kept = S.Written
    monkeypatch.setattr(S, "Written", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute.repeats(rows)))
    first = dict(made)["segments"].df
    assert first.where("dealt").count() > S.BLOCK_SEGMENTS
    assert dict(made)["strings"].df.count() < 2 * len(texts)
