"""Preprocessing, classifiers and grouped nested cross-validation with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators import contracts, metrics, sampling, weights
from pairwell.operators.resampling import Resamples
from pairwell.operators.scan import exact_percentiles, null_safe_join
from pairwell.plans import crossfit
from pairwell.plans.crossfit import Recipe, classifier
from pairwell.plans.preparation import Preparation, dimension_medians, fit_preparation
from pairwell.session import durable

__all__ = ["Preparation", "Recipe", "classifier", "dimension_medians", "fit_preparation"]


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Index of the label in alphabetical order."""
    model = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int"))


def labels_for_samples(samples: DataFrame, persons: DataFrame, person: str, label: str) -> DataFrame:
    """The label of a person on each of its samples."""
    return samples.join(persons.select(person, label), person)


def scope_features(df: DataFrame, scope: str, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Baseline features without recordings: ``age_sex``, ``comorbidities`` or both."""
    present = [F.col(c) for c in covariates if c in df.columns]
    columns = {
        "age": F.col("age").cast("double"),
        "sex": E.sex_code(F.col("sex"), ("m",)).cast("double"),
        "comorbidity_count_bin": E.count_bin(present).cast("double"),
    }
    scopes = {
        "age_sex": ["age", "sex"],
        "comorbidities": ["comorbidity_count_bin"],
        "age_sex_comorbidities": ["age", "sex", "comorbidity_count_bin"],
    }
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope}")
    return df.select(*keys, *[columns[c].alias(c) for c in scopes[scope]])


def nested_predictions(
    samples: DataFrame,
    person: str,
    label: str,
    recipe: Recipe,
    grid: Mapping[str, Sequence] | None = None,
    outer: int = 5,
    inner: int = 5,
    repeats: int = 1,
    inner_repeats: int = 1,
    scorer: str = "auroc",
    strategy: str = "flat",
    age: str | None = None,
    sex: str | None = None,
    alpha: float = 0.2,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """``person, y, score, fold, threshold, candidate``: test scores of grouped nested cross-validation.

    In every outer fold candidates are searched over inner folds of the training persons, the best one is fitted on
    all training rows, and a threshold is taken from out-of-fold scores of the training rows under population weights
    (by ``age`` and ``sex``). No person is on both sides of a split, which is checked; persons with two labels are an error.
    """
    base = samples.withColumn("y", F.col(label).cast("int"))
    folds = durable(sampling.repeated_folds(base, person, ["y"], outer, repeats, seed).select(person, "repeat", "fold"))
    crossfit.check_folds(base, folds, person, "y")
    placed = durable(base.drop("fold", "repeat").join(folds, person))
    candidates = crossfit.expand(grid)
    parts = []
    for fold in range(1, outer * repeats + 1):
        mine = placed.where(F.col("repeat") == (fold - 1) // outer)
        train, test = mine.where(F.col("fold") != fold).drop("fold", "repeat"), mine.where(F.col("fold") == fold)
        train = durable(weights.fold_weights(train, strategy, "y", person, "w", **({} if age is None else {"age": age, "sex": sex})))
        keep = [c for c in (age, sex) if c]
        chosen, params = 0, candidates[0]
        if len(candidates) > 1:
            found = crossfit.search(train, person, recipe, candidates, inner, inner_repeats, scorer, seed + fold, keep, parallelism)
            chosen, params, own = found.best, found.params, found.out_of_fold()
        else:
            own = crossfit.out_of_fold(train, person, recipe, params, inner, seed + fold, keep, parallelism)
        own = crossfit.population_weights(own, age, sex)
        threshold = crossfit.threshold_from_scores(own, "population_weight", "fpr", alpha)
        model = recipe.fit(train, params)
        scored = crossfit.scored(model, test.withColumn("w", F.lit(1.0)), [person, "y"])
        parts.append(scored.withColumns({"fold": F.lit(fold), "threshold": threshold.select("threshold").scalar(), "candidate": F.lit(chosen)}))
    return reduce(DataFrame.unionByName, parts)


def transfer(
    train: DataFrame,
    test: DataFrame,
    person: str,
    label: str,
    recipe: Recipe,
    grid: Mapping[str, Sequence] | None = None,
    inner: int = 5,
    inner_repeats: int = 3,
    scorer: str = "auroc",
    strategy: str = "ps_overlap",
    age: str | None = None,
    sex: str | None = None,
    replicates: int = 2000,
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Train on one cohort, judge on another: (pooled scores of the test persons, one row of figures).

    Candidates are searched on the training cohort, the threshold with the best weighted balanced accuracy comes from
    its out-of-fold scores. Figures are AUROC, AUROC under population weights and balanced accuracy at the threshold,
    each with a percentile interval over plain resamples of the test persons; one-class resamples are skipped.
    """
    covariates = {} if age is None else {"age": age, "sex": sex}
    ready = durable(weights.fold_weights(train.withColumn("y", F.col(label).cast("int")), strategy, "y", person, "w", **covariates))
    judged = test.withColumn("y", F.col(label).cast("int"))
    contracts.require_empty(contracts.label_conflicts(judged, person, "y"), "persons with several labels")
    candidates = crossfit.expand(grid)
    best, params, mean = 0, candidates[0], F.lit(None).cast("double")
    if len(candidates) > 1:
        found = crossfit.search(ready, person, recipe, candidates, inner, inner_repeats, scorer, seed, (), parallelism)
        best, params, own = found.best, found.params, found.out_of_fold()
        mean = found.means.where(F.col("candidate") == best).select("mean_value").scalar()
    else:
        own = crossfit.out_of_fold(ready, person, recipe, params, inner, seed, parallelism=parallelism)
    threshold = crossfit.threshold_from_scores(own, "w", "balanced_accuracy").select("threshold").scalar()
    model = recipe.fit(ready, params)
    scored = crossfit.scored(model, judged.withColumn("w", F.lit(1.0)), [person, "y", *covariates.values()])
    facts = [F.max(c).alias(c) for c in covariates.values()]
    pooled = scored.groupBy(person).agg(F.max("y").alias("y"), F.avg("score").alias("score"), *facts)
    pooled = durable(crossfit.population_weights(pooled, age, sex).withColumn("threshold", threshold))
    return pooled, transfer_figures(pooled, person, replicates, seed).withColumns({"candidate": F.lit(best), "search_value": mean})


def transfer_figures(pooled: DataFrame, person: str, replicates: int, seed: int = 42) -> DataFrame:
    """One row: the figures of ``transfer`` from pooled scores with ``population_weight`` and ``threshold``.

    The resamples are drawn once; every figure is computed per replicate from the same multiplicities.
    """
    drawn = Resamples(pooled.select(person, "y", "score", "population_weight", "threshold"), person, replicates, (), seed).store()
    # Replicate 0 is the cohort itself.
    points = {"auroc": ("score", None), "weighted_auroc": ("score", "population_weight")}
    areas = drawn.aurocs("y", points)
    whole = pooled.withColumn("b", F.lit(0))
    own = [metrics.auroc(whole, "y", *at, ["b"], out=name) for name, at in points.items()]
    areas = areas.unionByName(null_safe_join(*own, ["b"]))
    cell = lambda y, p: ((F.col("y") == y) & ((F.col("score") >= F.col("threshold")) == p)).cast("double")
    cells = drawn.sums({"tp": cell(1, True), "fn": cell(1, False), "fp": cell(0, True), "tn": cell(0, False)})
    cells = cells.unionByName(metrics.confusion(whole, "y", (F.col("score") >= F.col("threshold")).cast("int"), None, ["b"]))
    accuracy = metrics.rates(cells.where("tp + fn > 0 and fp + tn > 0")).select("b", "balanced_accuracy")
    figures = durable(null_safe_join(areas, accuracy, ["b"]))
    names = ["auroc", "weighted_auroc", "balanced_accuracy"]
    long = figures.where("b > 0").unpivot(["b"], names, "figure", "v")
    limits = exact_percentiles(long, "v", {"lo": 0.025, "hi": 0.975}, ["figure"], bounds=[])
    ends = limits.agg(*[F.max(F.when(F.col("figure") == n, F.col(e))).alias(f"{n}_{e}") for n in names for e in ("lo", "hi")])
    out = ends
    for n in names:
        out = out.withColumn(n, figures.where("b = 0").select(n).scalar())
    return out.withColumns({"threshold": pooled.agg(F.max("threshold").alias("t")).scalar(), "n_test": pooled.agg(F.count(F.lit(1)).alias("n")).scalar()})
