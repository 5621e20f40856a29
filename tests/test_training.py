import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pairwell.operators.propensity import fit_logistic, propensity_scores, score_logistic
from pairwell.plans import training


def vectors(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 2, 0.01, 3, 1]
    x[:, 4] = rng.integers(0, 2, n)
    w = rng.integers(1, 4, n).astype(float)
    rows = [(i, [float(v) for v in r], float(k), int(r[0] + rng.normal() > 0)) for i, (r, k) in enumerate(zip(x, w))]
    rows[3][1][1] = float("nan")
    return spark.createDataFrame(rows, "id int, v array<double>, w double, y int"), x, w


def test_preparation_matches_numpy(spark):
    df, x, w = vectors(spark)
    x = x.copy()
    x[3, 1] = np.median(np.delete(x[:, 1], 3))
    prepared = training.fit_preparation(df, "v", [3, 2], weight="w")
    assert prepared.kept == [0, 1, 3, 4]
    mean = np.average(x, axis=0, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    expected = ((x - mean) / sd)[:, [0, 1, 3, 4]]
    got = np.array([r.z for r in df.select("id", prepared.scaled(F.col("v")).alias("z")).orderBy("id").collect()])
    assert np.allclose(got, expected, atol=1e-9)


def test_blocks_are_projected_or_left_alone(spark):
    df, _, _ = vectors(spark)
    prepared = training.fit_preparation(df, "v", [4, 1], {0: 2, 1: 5})
    assert prepared.sizes == [2, 1]
    out = prepared.apply(df, "v").select(F.size(vector_to_array("features")).alias("n")).distinct().collect()
    assert [r.n for r in out] == [3]


def test_logistic_fit_zeroes_the_penalized_gradient(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + rng.normal(size=120) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    model = fit_logistic(df, "y", ["a", "b"], C=0.5, balanced=True)
    beta, b0 = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(b0 + x @ beta)))
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    assert np.allclose(beta + 0.5 * x.T @ (w * (p - y)), 0, atol=1e-4)
    assert abs(0.5 * (w * (p - y)).sum()) < 1e-4
    scored = [r.p for r in score_logistic(model, df, ["a", "b"], "p").collect()]
    assert np.allclose(scored, p)


def test_scores_without_covariates_are_neutral(spark):
    df = spark.createDataFrame([(1, 40.0, 1), (2, 50.0, 0)], "id int, age double, label int")
    assert {(r.ps, r.logit_ps) for r in propensity_scores(df, "label", ["absent"], use_age=False).collect()} == {(0.5, 0.0)}


def test_scopes(spark):
    df = spark.createDataFrame([(60, "m", 1, 1, 1), (50, "w", 0, None, 0)], "age int, sex string, a int, b int, c int")
    got = training.scope_features(df, "age_sex_comorbidities", ["a", "b", "c", "missing"]).collect()
    assert [tuple(r) for r in got] == [(60.0, 1.0, 2.0), (50.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        training.scope_features(df, "other", [])


def test_labels_are_numbered_alphabetically(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("b",)], "c string")
    assert {(r.c, r.i) for r in training.encode_labels(df, "c", "i").collect()} == {("a", 0), ("b", 1)}


def test_every_person_is_scored_once_and_by_a_model_that_never_saw_it(spark):
    df, _, _ = vectors(spark, 60, 3)
    samples = df.select(F.floor(F.col("id") / 2).alias("person"), "v", (F.floor(F.col("id") / 2) % 3 == 0).cast("int").alias("label"))
    out = training.nested_predictions(samples, "person", "label", training.Recipe("LogisticRegression", "v", (5,)), outer=2, inner=2).toPandas()
    assert len(out) == 60 and set(out.fold) == {1, 2}
    assert (out.groupby("person").fold.nunique() == 1).all()
    assert out.score.between(0, 1).all()
