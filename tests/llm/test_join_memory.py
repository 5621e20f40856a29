"""What the n-gram join holds at once: no sort buffers of empty partitions, few bytes of text, one buffer of shingles."""

from __future__ import annotations

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pairwell.llm import components as C
from pairwell.llm import ngram_join


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rounds_of_a_small_graph_shuffle_nothing(spark, many_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1)
    edges = ngram_join.durable(edges.distinct())
    spark.sparkContext.setJobGroup("small graph", "rounds")
    labels = C.components(edges)
    spark.sparkContext._jsc.clearJobGroup()
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("small graph") for s in told.getJobInfo(j).stageIds}
    tasks = [i.numTasks for s in stages if (i := told.getStageInfo(s)) is not None]
    assert {r["comp"] for r in labels.collect()} == {0}
    # The edges lie in all partitions; what the rounds make of them does not.
    assert tasks and sum(n >= 64 for n in tasks) <= 2


def test_text_comes_in_small_batches(spark):
    rows = [(d, f"{d % 300} " + "word " * 4000) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    with ngram_join.small_batches(spark):
        most = max(r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect())
    assert most < 4_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()}
    assert got == brute.classes(rows)


def test_shingles_are_held_once():
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(300)).encode() for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    list(ngram_join.sketched(1)(iter([batch.slice(0, 200)])))
    tracemalloc.start()
    for _ in ngram_join.sketched(1)(batch.slice(i, 200) for i in range(0, 4000, 200)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The buffer counts whole, although of it only the 9.5 MB of hashes are touched.
    assert peak - 8 * ngram_join.COUNTED < 9_500_000


def test_full_buffers_count_the_same(monkeypatch):
    texts = [f"a b c d e f{i % 3} g{i}".encode() for i in range(30)] + [b" ".join(b"x%d" % i for i in range(90))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(31), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    def run():
        out = [x for b in ngram_join.sketched(1)(iter([batch])) for x in b.to_pylist()]
        return [x for x in out if x["token"] is None], {x["token"] for x in out if x["token"] is not None}

    whole, often = run()
    monkeypatch.setattr(ngram_join, "COUNTED", 40)
    again, found = run()
    assert [(x["doc_id"], x["n"], x["node"], x["check"]) for x in again] == [(x["doc_id"], x["n"], x["node"], x["check"]) for x in whole]
    assert len(whole) == 31 and found and found <= often
    assert np.int64(len(often)) >= 1
