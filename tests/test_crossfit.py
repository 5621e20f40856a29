import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from pairwell.operators.contracts import ContractError
from pairwell.plans import crossfit, training
from pairwell.plans.crossfit import Recipe
from pairwell.plans.preparation import BlockPreparation, dimension_medians, fit_preparation

TWO = Recipe("LogisticRegression", "v", (2,))


def rows_of(spark, n=90, seed=5, persons=60):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, persons)
    out = [(i % persons, int(y[i % persons]), float(rng.integers(1, 4)), [float(rng.normal() + y[i % persons]), float(rng.normal() * 3)]) for i in range(n)]
    return spark.createDataFrame(out, "person int, y int, w double, v array<double>").repartition(4)


def folds_of(rows, k=2, repeats=1):
    from pairwell.operators import sampling

    return sampling.repeated_folds(rows, "person", ["y"], k, repeats, 1)


def test_every_row_is_scored_once_in_each_repeat(spark):
    rows = rows_of(spark)
    scores = crossfit.cross_fit(rows, "person", folds_of(rows, 2, 2), TWO, [{"C": 0.1}, {"C": 10.0}])
    counts = scores.groupBy("candidate", "repeat").count().collect()
    assert len(counts) == 4 and all(r["count"] == 90 for r in counts)
    assert scores.groupBy("person", "repeat").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


def test_leaks_and_conflicting_labels_raise(spark):
    rows = rows_of(spark)
    folds = folds_of(rows)
    twice = folds.union(folds.limit(1).withColumn("fold", F.col("fold") % 2 + 1))
    with pytest.raises(ContractError, match="both sides"):
        crossfit.cross_fit(rows, "person", twice, TWO, [{}])
    with pytest.raises(ContractError, match="without a fold"):
        crossfit.cross_fit(rows, "person", folds.where("person > 3"), TWO, [{}])
    other = rows.union(rows.where("person = 1").withColumn("y", 1 - F.col("y")))
    with pytest.raises(ContractError, match="several labels"):
        crossfit.cross_fit(other, "person", folds, TWO, [{}])
    with pytest.raises(ContractError, match="several labels"):
        training.nested_predictions(other, "person", "y", TWO, outer=2, inner=2)


def plain(scorer, rows):
    """A scorer over (y, w, score) by pairs and steps."""
    y, w, s = (np.array([r[c] for r in rows], float) for c in ("y", "w", "score"))
    up, down = y == 1, y == 0
    if scorer == "auroc":
        won = (s[up][:, None] > s[down][None, :]) + 0.5 * (s[up][:, None] == s[down][None, :])
        return float((w[up][:, None] * w[down][None, :] * won).sum() / (w[up].sum() * w[down].sum()))
    if scorer == "average_prec":
        total = 0.0
        for v in np.unique(s):
            above = s >= v
            total += w[up & (s == v)].sum() / w[up].sum() * w[up & above].sum() / w[above].sum()
        return float(total)
    if scorer == "partial_auroc_weighted":
        cuts = np.concatenate([[np.inf], np.unique(s)[::-1]])
        fpr = np.array([w[down & (s >= c)].sum() / w[down].sum() for c in cuts])
        tpr = np.array([w[up & (s >= c)].sum() / w[up].sum() for c in cuts])
        inside = fpr <= 0.25
        xs, ys = np.append(fpr[inside], 0.25), np.append(tpr[inside], np.interp(0.25, fpr, tpr))
        area = ((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2).sum()
        return float(0.5 * (1 + (area - 0.03125) / (0.25 - 0.03125)))
    p = s > 0.5
    tp, fn, fp, tn = w[up & p].sum(), w[up & ~p].sum(), w[down & p].sum(), w[down & ~p].sum()
    if scorer == "balanced_accuracy":
        return float((tp / (tp + fn) + tn / (tn + fp)) / 2)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return float((tp * tn - fp * fn) / np.sqrt(product)) if product else 0.0


def test_scorers_equal_the_stored_scores(spark):
    rows = rows_of(spark)
    found = crossfit.search(rows, "person", TWO, crossfit.expand({"C": [0.001, 1.0]}), 2, 1, "auroc")
    table = found.scores.collect()
    for scorer in crossfit.SCORERS:
        values = {(r["candidate"], r["fold"]): r["value"] for r in crossfit.fold_values(found.scores, scorer).collect()}
        assert len(values) == 4
        for (candidate, fold), value in values.items():
            mine = [r for r in table if (r["candidate"], r["fold"]) == (candidate, fold)]
            assert value == pytest.approx(plain(scorer, mine), abs=1e-9), scorer
        means = {r["candidate"]: r["mean_value"] for r in crossfit.candidate_means(found.scores, scorer).collect()}
        assert means[0] == pytest.approx(np.mean([v for (c, _), v in values.items() if c == 0]))
    assert found.out_of_fold().count() == rows.count()
    with pytest.raises(ValueError, match="unknown scorer"):
        crossfit.search(rows, "person", TWO, [{}], 3, scorer="accuracy")


def test_first_of_equal_candidates_and_undefined_folds(spark):
    rows = rows_of(spark)
    assert crossfit.search(rows, "person", TWO, [{"C": 1.0}, {"C": 1.0}], 2).best == 0
    assert crossfit.expand({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    scores = spark.createDataFrame([(0, 1, 1, 1.0, 0.9), (0, 2, 0, 1.0, 0.1), (1, 1, 1, 1.0, 0.9), (1, 1, 0, 1.0, 0.2)], "candidate int, fold int, y int, w double, score double")
    means = {r["candidate"]: r["mean_value"] for r in crossfit.candidate_means(scores, "auroc").collect()}
    assert means == {0: None, 1: 1.0}


def test_medians_by_brackets(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=301), np.full(301, np.nan), rng.integers(0, 3, 301), 10.0 ** rng.integers(-300, 300, 301), np.full(301, 7.0), -np.abs(rng.normal(size=301))])
    x[::3, 0] = np.nan
    x[1, 5], x[2, 5] = np.inf, -np.inf
    df = spark.createDataFrame([([None if i % 7 == 0 and d == 2 else float(v) for d, v in enumerate(r)],) for i, r in enumerate(x)], "v array<double>").repartition(3)
    x[::7, 2] = np.nan
    for bins in (4, 1024):
        got = dimension_medians(df, "v", bins)
        assert got[1] is None
        assert [got[d] for d in (0, 2, 3, 4, 5)] == [float(np.nanmedian(x[:, d])) for d in (0, 2, 3, 4, 5)]
    assert dimension_medians(df.limit(0), "v") == []


def test_a_dimension_without_values_does_not_shift_the_others(spark):
    df = spark.createDataFrame([([1.0 * i, None, 5.0 + i * i, None if i == 3 else 2.0 * i], i % 2) for i in range(9)], "v array<double>, y int")
    prepared = fit_preparation(df, "v", [2, 2])
    assert prepared.kept == [0, 2, 3] and prepared.medians[1] is None and prepared.medians[3] == 9.0
    assert prepared.sizes == [1, 2]


def test_preparation_as_a_pipeline_stage(spark):
    """Fitted by itself where a pipeline is fitted; the projection is a parameter."""
    rows = rows_of(spark)
    step = BlockPreparation("v", [2], weight="w")
    model = Pipeline(stages=[step, crossfit.classifier("LogisticRegression", weight="w")]).fit(rows)
    direct = TWO.fit(rows, {})
    assert np.allclose(model.stages[1].coefficients.toArray(), direct.stages[1].coefficients.toArray())
    one = step.copy({step.components: {0: 1}}).fit(rows)
    assert one.preparation.sizes == [1] and step.fit(rows).preparation.sizes == [2]
    half = BlockPreparation("v", [2]).fit(rows.where("person < 30")).preparation
    assert half.mean != BlockPreparation("v", [2]).fit(rows).preparation.mean


def test_transfer_figures(spark):
    rows = rows_of(spark)
    pooled, figures = training.transfer(rows.where("person < 30"), rows.where("person >= 30"), "person", "y", TWO, None, 2, 1, strategy="class_only", replicates=50)
    got, table = figures.collect()[0], pooled.collect()
    assert got["n_test"] == len(table) == 30
    plain_rows = [{"y": r["y"], "w": 1.0, "score": r["score"]} for r in table]
    assert got["auroc"] == pytest.approx(plain("auroc", plain_rows)) == pytest.approx(got["weighted_auroc"])
    assert got["auroc_lo"] <= got["auroc"] <= got["auroc_hi"]
    p, y = np.array([r["score"] >= got["threshold"] for r in table]), np.array([r["y"] for r in table])
    assert got["balanced_accuracy"] == pytest.approx((p[y == 1].mean() + 1 - p[y == 0].mean()) / 2)
