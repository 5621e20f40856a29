import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions import special
from pairwell.operators import ranking, stats, weights


def exact_fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = {k: Fraction(math.comb(row, k) * math.comb(n - row, col - k), math.comb(n, col)) for k in range(max(0, col - (n - row)), min(row, col) + 1)}
    return float(sum(v for v in p.values() if v <= p[a]))


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 6, 1), (12, 30, 25, 11), (2, 0, 0, 2)])
def test_fisher_matches_fractions(cells):
    assert special.fisher_two_sided(*cells) == pytest.approx(exact_fisher(*cells), rel=1e-9)


def test_tail_probabilities():
    assert special.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), rel=1e-12)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert special.chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert special.chi_square_tail(40.0, 2) == pytest.approx(math.exp(-20), rel=1e-10)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    x = np.array([0.5, 1.0, 5.5, 30.0, 1000.0])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def test_benjamini_hochberg_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2, 0.04]
    got = stats.benjamini_hochberg(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p", "q").orderBy("i").collect()
    assert [round(r.q, 10) for r in got] == [0.03, 0.048, 0.048, 0.03, 0.2, 0.048]


def test_random_intercept_on_a_balanced_design(spark):
    rng = np.random.default_rng(4)
    groups = [[float(x) for x in 10 + g * 3 + rng.normal(size=3)] for g in range(4)]
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs]
    df = spark.createDataFrame(rows, "g int, x double")
    table, facts = stats.random_intercept(df, "x", "g", {})
    means = [np.mean(g) for g in groups]
    within = sum((x - m) ** 2 for g, m in zip(groups, means) for x in g) / 8
    between = 3 * np.var(means, ddof=1)
    assert facts["residual_var"] == pytest.approx(within, rel=1e-5)
    assert facts["group_var"] == pytest.approx((between - within) / 3, rel=1e-5)
    row = table.first()
    assert row.estimate == pytest.approx(np.mean([x for _, x in rows]))
    assert row.se == pytest.approx(math.sqrt(between / 12), rel=1e-5)


def test_random_intercept_without_group_effect_is_least_squares(spark):
    rows = [(g, f, x) for g in range(3) for f, x in [("a", 5.0), ("a", 6.0), ("b", 1.0), ("b", 2.0)]]
    df = spark.createDataFrame(rows, "g int, f string, x double")
    table, facts = stats.random_intercept(df, "x", "g", stats.factor_levels(df, {"f": ("f", "a")}))
    got = {r.term: r.estimate for r in table.collect()}
    a = np.mean([x for _, f, x in rows if f == "a"])
    b = np.mean([x for _, f, x in rows if f == "b"])
    assert facts["group_var"] == pytest.approx(0, abs=1e-6)
    assert got["Intercept"] == pytest.approx(a) and got["f: b"] == pytest.approx(b - a)


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 15.0), (4.0, 40.0)], "a double, b double")
    expected = np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1]
    assert ranking.spearman(df, "a", "b").first().spearman == pytest.approx(expected)


def strata(spark, cells, minimum=2):
    """cells: (age, sex, label, how many)."""
    rows = [(float(a), s, y) for a, s, y, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "age double, sex int, label int")
    return weights.strata_weights(df, "label", "age", "sex", min_controls=minimum, clip_at=None)


def test_enough_controls_means_no_merge(spark):
    got = strata(spark, [(60, 0, 0, 3), (70, 0, 0, 3), (80, 0, 0, 3), (60, 0, 1, 2)])
    assert {r.band for r in got.select("band").distinct().collect()} == {"<=65", "66-75", ">75"}
    w = {(r.band, r.label): r.strata_weight for r in got.collect()}
    assert w[("<=65", 0)] == pytest.approx(0.361 * 0.463 / (3 / 9))
    assert w[("<=65", 1)] == pytest.approx(0.361 * 0.463)


def test_a_stratum_without_controls_does_not_ask_for_a_merge(spark):
    got = strata(spark, [(60, 0, 1, 3), (70, 0, 0, 3), (80, 0, 0, 3)])
    assert "<=65" in {r.band for r in got.collect()}


def test_a_sparse_stratum_merges_the_lowest_bands(spark):
    got = strata(spark, [(60, 0, 0, 1), (70, 0, 0, 3), (80, 0, 0, 3)])
    assert {r.band for r in got.collect()} == {"<=75", ">75"}
    got = strata(spark, [(60, 0, 0, 1), (70, 0, 0, 3), (80, 0, 0, 1)])
    assert {r.band for r in got.collect()} == {"<=75+>75"}


def test_missing_age_falls_in_the_last_band(spark):
    df = spark.createDataFrame([(None, 0, 0), (50.0, 0, 0), (None, 0, 0), (50.0, 0, 0)], "age double, sex int, label int")
    bands = [r.band for r in weights.strata_weights(df, "label", "age", "sex").collect()]
    assert sorted(bands) == ["<=65", "<=65", ">75", ">75"]


def test_weights_per_person_and_small_samples(spark):
    df = spark.createDataFrame([(1, 1, 50.0, 0), (1, 1, 50.0, 0), (2, 0, 60.0, 1)], "pid int, label int, age double, sex int")
    flat = {(r.pid, r.weight) for r in weights.fold_weights(df, "flat", "label", "pid").collect()}
    assert flat == {(1, 0.5), (2, 1.0)}
    # Fewer than 20 effective rows: overlap weights give way to flat ones, before sharing out.
    overlap = {(r.pid, r.weight) for r in weights.fold_weights(df, "ps_overlap", "label", "pid").collect()}
    assert overlap == {(1, 0.5), (2, 1.0)}
    with pytest.raises(ValueError):
        weights.fold_weights(df, "other", "label", "pid")


def test_effective_sample_size(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "w double")
    assert df.agg(weights.ess(F.col("w"))).first()[0] == pytest.approx(16 / 6)
    assert df.where("w > 5").agg(weights.ess(F.col("w"))).first()[0] == 0.0
