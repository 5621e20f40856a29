"""Small tables of the n-gram join lie in few partitions, also with many shuffle partitions: each is a file of every checkpoint."""

from __future__ import annotations

import random

import brute
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


def test_labels_of_a_small_graph_are_one_file(spark, many_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long").repartition(40)
    labels = C.components(edges)
    assert labels.rdd.getNumPartitions() == 1
    assert {r["node"]: r["comp"] for r in labels.collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_join_writes_few_files(spark, many_partitions, monkeypatch):
    draw = random.Random(11)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base = [words(60) for _ in range(30)]
    rows = [(d, " ".join(base[d % 30][: 50 + draw.randrange(10)] + words(draw.randrange(6)))) for d in range(200)]
    files, kept = [], ngram_join.durable

    def counted(df):
        out = kept(df)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(ngram_join, "durable", counted)
    monkeypatch.setattr(C, "durable", counted)
    got = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.classes(rows)
    assert sum(n == 1 for n in files) > len(files) / 2
    assert sum(files) < 16 * len(files)
