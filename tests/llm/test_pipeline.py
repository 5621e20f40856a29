"""The pipeline against the contracts in plain Python, stage after stage."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {d: t for d, t in rows.items() if brute.quality(t)[-1]}
    found = brute.classes(list(good.items()))
    single = {d: t for d, t in good.items() if found[d][1] == d}
    clean = {r[0] for r in brute.contamination(list(single.items()), items) if not r[-1]}
    expected = [set(good), set(single), clean]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = str(tmp_path / str(i))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        ids = [r[0] for r in docs.select("doc_id").collect()]
        if i < 3:
            assert sorted(ids) == sorted(expected[i])
        if i < 4:
            assert docs.columns == before.columns
    mixed = Counter(r[0] for r in before.select("doc_id").collect())
    assert set(mixed) <= clean and Counter(ids) == mixed
