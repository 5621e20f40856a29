import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairwell.operators import scan


def frame(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"k": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "x": rng.normal(size=n).round(1), "i": range(n)})


def test_cumulate_matches_pandas_in_every_block(spark):
    pdf = frame(spark)
    counts = pdf.groupby(["k", "x"], dropna=False).size().reset_index(name="n")
    df = spark.createDataFrame(counts.astype({"k": object}).where(counts.notna(), None))
    for bounds in ([], [-1.0, 0.0, 0.5], None):
        got = scan.cumulate(df, ["k"], "x", ["n"], bounds).toPandas()
        got["k"] = got.k.fillna("-")
        ref = counts.assign(k=counts.k.fillna("-")).sort_values(["k", "x"])
        ref["before"] = ref.groupby("k").n.cumsum() - ref.n
        ref["total"] = ref.groupby("k").n.transform("sum")
        merged = got.merge(ref, on=["k", "x"])
        assert len(merged) == len(ref)
        assert (merged.n_before == merged.before).all() and (merged.n_total == merged.total).all()


def test_exact_percentiles_match_numpy(spark):
    pdf = frame(spark, 777, 1)
    df = spark.createDataFrame(pdf[["x"]])
    row = scan.exact_percentiles(df, "x", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    assert np.allclose([row.a, row.b, row.c], np.percentile(pdf.x, [1, 50, 99]))
    assert row.n == 777


def test_median_of_an_even_count_lies_in_the_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert scan.column_medians(df, ["x"]) == {"x": 2.5}


def test_hash_ranks_are_dense_per_key(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int")).withColumn("h", scan.md5_number("s", F.col("id")))
    got = scan.hash_ranks(df, ["k"], "h", ["id"], "r").toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g.r) == list(range(len(g)))
        assert g.sort_values("r").h.is_monotonic_increasing


def test_numbered_gives_the_same_with_and_without_a_window(spark):
    pdf = frame(spark, 300, 2)
    df = spark.createDataFrame(pdf.astype({"k": object}).where(pdf.notna(), None))
    a = scan.numbered(df, ["k"], ["x", "i"], "n").select("i", "n").toPandas().sort_values("i").n.tolist()
    b = scan.numbered(df, ["k"], ["x", "i"], "n", window_rows=10).select("i", "n").toPandas().sort_values("i").n.tolist()
    assert a == b


def test_block_of_follows_the_limits(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (1.5,), (2.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(scan.block_of(F.col("x"), [1.0, 2.0])).collect()]
    assert got == [0, 0, 1, 1, 2]


def test_an_empty_frame_has_no_limits(spark):
    assert scan.value_bounds(spark.createDataFrame([], "x double"), "x") == []
