import numpy as np
import pandas as pd
import pytest

from pairwell.operators import metrics


def data(n=200, seed=0, digits=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"y": rng.integers(0, 2, n), "s": rng.random(n).round(digits), "w": rng.integers(1, 5, n) / 2})


def pair_auroc(d):
    p, q = d[d.y == 1], d[d.y == 0]
    win = (p.s.values[:, None] > q.s.values[None]) + 0.5 * (p.s.values[:, None] == q.s.values[None])
    return (win * p.w.values[:, None] * q.w.values[None]).sum() / (p.w.sum() * q.w.sum())


@pytest.mark.parametrize("digits", [1, 6])
def test_auroc_equals_the_pair_count(spark, digits):
    d = data(digits=digits)
    got = metrics.auroc(spark.createDataFrame(d), "y", "s", "w").first()[0]
    assert got == pytest.approx(pair_auroc(d), abs=1e-12)


def test_auroc_by_hand_and_its_symmetries(spark):
    # Positives score .8 .5 .5, negatives .5 .2: won 1 + 1 + (.5 + 1) * 2 = 5 of 6.
    rows = [(1, 0.8), (1, 0.5), (1, 0.5), (0, 0.5), (0, 0.2)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert metrics.auroc(df, "y", "s").first()[0] == pytest.approx(5 / 6)
    flipped = spark.createDataFrame([(y, -s) for y, s in rows], "y int, s double")
    assert metrics.auroc(flipped, "y", "s").first()[0] == pytest.approx(1 / 6)
    scaled = spark.createDataFrame([(y, s, 7.0) for y, s in rows], "y int, s double, w double")
    assert metrics.auroc(scaled, "y", "s", "w").first()[0] == pytest.approx(5 / 6)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.1, "a"), (1, 0.2, "a"), (0, 0.1, "b"), (1, 0.3, "b")], "y int, s double, g string")
    got = {r.g: r.auroc for r in metrics.auroc(df, "y", "s", keys=["g"]).collect()}
    assert got == {"a": None, "b": 1.0}


def test_average_precision_by_hand(spark):
    # From the top: hit (1/1), miss, hit (2/3): 0.5 * 1 + 0.5 * 2/3.
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 + 1 / 3)


def roc(d):
    out = [(0.0, 0.0, np.inf)]
    for t in sorted(d.s.unique(), reverse=True):
        k = d[d.s >= t]
        out.append((k[k.y == 0].w.sum() / d[d.y == 0].w.sum(), k[k.y == 1].w.sum() / d[d.y == 1].w.sum(), t))
    return out


def test_roc_rows_without_dropping(spark):
    d = data(80, 3)
    got = metrics.roc_points(spark.createDataFrame(d), "y", "s", "w", drop_collinear=False).toPandas().sort_values("threshold", ascending=False)
    assert np.allclose(got[["fpr", "tpr"]].values, [r[:2] for r in roc(d)])


def test_collinear_points_go(spark):
    # Three single positives in a row, then a negative: the middle of the rise is dropped.
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6)], "y int, s double")
    got = metrics.roc_points(df, "y", "s", bounds=[0.75]).toPandas().sort_values("threshold", ascending=False)
    assert got.threshold.tolist() == [np.inf, 0.9, 0.7, 0.6]


def test_partial_auroc_by_trapezoid(spark):
    d = data(150, 5)
    pts = np.array([r[:2] for r in roc(d)])
    x = np.concatenate([pts[pts[:, 0] <= 0.2, 0], [0.2]])
    y = np.concatenate([pts[pts[:, 0] <= 0.2, 1], [np.interp(0.2, pts[:, 0], pts[:, 1])]])
    area = ((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum()
    expected = 0.5 * (1 + (area - 0.02) / 0.18)
    assert metrics.partial_auroc(spark.createDataFrame(d), "y", "s", 0.2, "w").first()[0] == pytest.approx(expected)


def test_threshold_may_be_infinite(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    points = metrics.roc_points(df, "y", "s")
    assert metrics.threshold_at_fpr(points, 0.1).first().threshold == float("inf")


def test_rates_and_deployment(spark):
    cells = spark.createDataFrame([(8.0, 2.0, 1.0, 9.0), (0.0, 0.0, 0.0, 5.0)], "tp double, fn double, fp double, tn double")
    a, b = metrics.deployment(metrics.rates(cells), 0.2).collect()
    assert (a.tpr, a.fpr, a.balanced_accuracy) == pytest.approx((0.8, 0.1, 0.85))
    assert a.mcc == pytest.approx((72 - 2) / np.sqrt(9 * 10 * 10 * 11))
    assert a.ppv == pytest.approx(0.16 / 0.24) and a.npv == pytest.approx(0.72 / 0.76) and a.fp_per_1000 == pytest.approx(80)
    assert b.mcc is None and b.ppv is None
    assert metrics.deployment(metrics.rates(cells), 1.0).first().ppv is None
