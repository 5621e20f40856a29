"""Audit of predictions: per fold, over folds, per group and against a comparator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators import joins, metrics, reshape, sampling, weights
from pairwell.operators.resampling import Resamples
from pairwell.operators.scan import exact_percentiles, null_safe_join, value_bounds
from pairwell.session import durable


def fold_predictions(
    chunks: DataFrame, persons: DataFrame, person: str, label: str, score: str, keys: Sequence[str],
    age: str = "age", sex: str = "sex", threshold: float = 0.5, min_controls: int = 2,
) -> DataFrame:
    """Person-level predictions per fold, with strata weights made inside each fold."""
    pooled = reshape.pool_chunks(chunks, person, label, score, keys)
    joined = pooled.join(persons.select(person, age, sex), person)
    predicted = joined.withColumn("pred", (F.col(score) >= threshold).cast("int"))
    return weights.strata_weights(predicted, label, age, sex, "strata_weight", min_controls, keys).drop("band")


def fold_metrics(predictions: DataFrame, label: str, score: str, keys: Sequence[str], prevalence: float = 0.2) -> DataFrame:
    """Unweighted and weighted ranking metrics, threshold metrics and deployment metrics per fold."""
    keys = list(keys)
    ranking = metrics.ranking_metrics(predictions, label, score, {"": None, "weighted_": "strata_weight"}, keys)
    plain = metrics.confusion(predictions, label, F.col("pred"), None, keys)
    weighted = metrics.confusion(predictions, label, F.col("pred"), "strata_weight", keys)
    at = metrics.rates(plain).select(*keys, "balanced_accuracy", F.coalesce("mcc", F.lit(0.0)).alias("mcc"))
    weighted_at = metrics.deployment(metrics.rates(weighted), prevalence).select(
        *keys, F.col("balanced_accuracy").alias("weighted_balanced_accuracy"), F.col("mcc").alias("weighted_mcc"),
        "ppv", "npv", "fp_per_1000",
    )
    return null_safe_join(null_safe_join(ranking, at, keys), weighted_at, keys)


def compare_scores(
    persons: DataFrame, person: str, label: str, score: str, comparator: str, weight: str | None,
    replicates: int, seed: int = 42,
) -> DataFrame:
    """Point AUROCs of two scores, their bootstrap intervals and the paired difference, one row."""
    draws = sampling.bootstrap_auroc(persons, person, label, [score, comparator], weight, replicates, True, seed)
    named = draws.select(
        F.col(score).alias("a"), F.col(comparator).alias("b"), (F.col(score) - F.col(comparator)).alias("d")
    )
    figures = named.unpivot([], ["a", "b", "d"], "figure", "v")
    # One row per figure and replicate: stored, since limits and the share above zero both read it.
    figures = durable(figures)
    limits = exact_percentiles(figures, "v", {"lo": 0.025, "hi": 0.975}, ["figure"], bounds=[])
    above = figures.where("figure = 'd' and v is not null").agg(F.avg((F.col("v") > 0).cast("double"))).scalar()
    at = lambda figure, end: F.max(F.when(F.col("figure") == figure, F.col(end)))
    points = durable(
        metrics.aurocs(
            persons.withColumn("_all", F.lit(0)), label, [score, comparator], weight, ["_all"],
            {s: value_bounds(persons, s) for s in (score, comparator)},
        )
    )
    own = limits.agg(
        at("a", "lo").alias("auroc_lo"), at("a", "hi").alias("auroc_hi"),
        at("b", "lo").alias("comparator_lo"), at("b", "hi").alias("comparator_hi"),
        at("d", "lo").alias("diff_lo"), at("d", "hi").alias("diff_hi"),
    )
    named = own.withColumns(
        {
            "frac_diff_gt0": above,
            "auroc": points.select(score).scalar(),
            "comparator_auroc": points.select(comparator).scalar(),
        }
    )
    return named.withColumn("diff", F.col("auroc") - F.col("comparator_auroc"))


def covariate_as_score(predictions: DataFrame, covariate: DataFrame, person: str, column: str, score: str) -> DataFrame:
    """The same predictions with a raw covariate in place of the score; persons without it go."""
    joined = joins.map_values(predictions.drop(score), covariate, person, column)
    return joined.withColumn(score, F.col(column).cast("double")).where(F.col(score).isNotNull())


def threshold_sweep(
    persons: DataFrame, person: str, label: str, score: str, thresholds: Sequence[float], replicates: int, seed: int = 42
) -> DataFrame:
    """Bootstrap interval of the balanced accuracy at each threshold; one-class replicates are skipped."""
    drawn = Resamples(persons.select(person, label, score), person, replicates, (), seed)
    names = ("tp", "fn", "fp", "tn")
    cell = lambda y, p, x: ((F.col(label) == y) & ((F.col(score) >= x) == p)).cast("double")
    cells = {
        f"{n}{i}": cell(y, p, float(x))
        for i, x in enumerate(thresholds)
        for n, (y, p) in zip(names, ((1, True), (1, False), (0, True), (0, False)))
    }
    steps = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i, x in enumerate(thresholds)])
    rows = drawn.sums(cells).select("b", F.inline(steps))
    kept = metrics.rates(rows.where("tp + fn > 0 and fp + tn > 0"))
    # One row for each threshold and replicate needs no blocks.
    return exact_percentiles(kept, "balanced_accuracy", {"lo": 0.025, "hi": 0.975}, ["threshold"], bounds=[])
