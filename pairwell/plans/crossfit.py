"""Scores of rows by models that did not see their persons, stored as one table, and what is chosen from them.

Models are keyed by candidate and fold. Each is fitted on the rows outside its fold, preparation included, and scores
the rows inside; the parts are written below one path and read as one table. Grid search, out-of-fold scores and
thresholds are then grouped queries over that table, whatever the number of candidates, folds and repeats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.operators import contracts, metrics, sampling, weights
from pairwell.plans.preparation import BlockPreparation
from pairwell.session import durable, scratch_path

SCORERS = ("matthews_corrcoef", "balanced_accuracy", "auroc", "partial_auroc_weighted", "average_prec")
PARTIAL_LIMIT = 0.25
Params = Mapping[str, object]


def classifier(name: str, seed: int = 42, weight: str | None = None):
    """Spark ML classifier by name."""
    extra = {} if weight is None else {"weightCol": weight}
    if name == "LogisticRegression":
        return LogisticRegression(labelCol="y", standardization=False, maxIter=1000, tol=1e-8, **extra)
    if name == "RandomForestClassifier":
        return RandomForestClassifier(labelCol="y", seed=seed, **extra)
    if name == "GBTClassifier":
        return GBTClassifier(labelCol="y", seed=seed, **extra)
    raise ValueError(f"unsupported classifier {name}")


def expand(grid: Mapping[str, Sequence] | None) -> list[dict]:
    """The candidates of a grid, in the order of its lists; the last name varies fastest."""
    names = list(grid or {})
    return [dict(zip(names, values, strict=True)) for values in product(*[(grid or {})[n] for n in names])]


@dataclass(frozen=True)
class Recipe:
    """What is fitted: columns ``y`` and ``w`` are label and weight of a row.

    Of a candidate's parameters, ``components`` goes to the preparation, ``C`` (inverse penalty of a logistic model
    with respect to the sum of weights) to the penalty, the others to the classifier under their own names.
    """

    name: str
    vector: str
    block_sizes: tuple[int, ...]
    components: Mapping[int, int] | None = None
    minimum_variance: float = 0.01
    seed: int = 42

    def prepare(self, params: Params) -> BlockPreparation:
        wanted = params.get("components", self.components or {})
        return BlockPreparation(self.vector, self.block_sizes, wanted, "w", self.minimum_variance)

    def learner(self, params: Params, total_weight: float):
        learner = classifier(self.name, self.seed, "w")
        chosen = {k: v for k, v in params.items() if k not in ("components", "C")}
        if "C" in params:
            chosen["regParam"] = 1.0 / (float(params["C"]) * total_weight)
        return learner.copy({learner.getParam(k): v for k, v in chosen.items()})

    def fit(self, train: DataFrame, params: Params) -> PipelineModel:
        return self.fit_all(train, [params])[0]

    def fit_all(self, train: DataFrame, candidates: Sequence[Params]) -> list[PipelineModel]:
        """One model for each candidate; candidates with the same projections share a fitted preparation."""
        total = train.agg(F.sum("w").alias("w")).first()["w"] if any("C" in c for c in candidates) else 0.0
        ready: dict[str, tuple] = {}
        out = []
        for params in candidates:
            step = self.prepare(params)
            key = repr(sorted(step.getOrDefault("components").items()))
            if key not in ready:
                fitted = step.fit(train)
                ready[key] = (fitted, fitted.transform(train).select("y", "w", "features"))
            fitted, rows = ready[key]
            out.append(PipelineModel([fitted, self.learner(params, total).fit(rows)]))
        return out

    def pipeline(self, params: Params, total_weight: float = 1.0) -> Pipeline:
        """The same steps as one estimator."""
        return Pipeline(stages=[self.prepare(params), self.learner(params, total_weight)])


def scored(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def check_folds(rows: DataFrame, folds: DataFrame, person: str, label: str) -> None:
    """Raise if a person has two labels, two folds of a repeat, or none.

    ``folds`` has ``person, repeat, fold``: a person in two folds would be on both sides of a split.
    """
    contracts.require_empty(contracts.label_conflicts(rows, person, label), "persons with several labels")
    contracts.require_empty(contracts.leaks(folds, "repeat", person, "fold"), "persons on both sides of a split")
    contracts.require_empty(rows.select(person).distinct().join(folds, person, "left_anti"), "persons without a fold")


def cross_fit(
    rows: DataFrame, person: str, folds: DataFrame, recipe: Recipe, candidates: Sequence[Params], keep: Sequence[str] = (), parallelism: int = 4
) -> DataFrame:
    """``candidate, fold, person, y, w, score`` and ``keep``: every row scored once in each repeat by each candidate.

    ``folds`` has ``person, repeat, fold`` with fold numbers that differ between repeats. The placed rows are stored by
    repeat and fold, so a fit reads the folds it needs. The loop is over folds, not rows; ``parallelism`` fits run at a time.
    """
    spark = rows.sparkSession
    # The checks, the numbers and the join read both; their plans are run once.
    rows, folds = durable(rows), durable(folds.select(person, "repeat", "fold"))
    check_folds(rows, folds, person, "y")
    placed_path, path = scratch_path(spark, "placed"), scratch_path(spark, "cross_fit")
    rows.drop("repeat", "fold").join(folds, person).write.partitionBy("repeat", "fold").parquet(placed_path)
    placed = spark.read.parquet(placed_path)
    numbers = [tuple(r) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    columns = list(dict.fromkeys([person, "y", "w", *keep]))

    def fit_and_score(at: tuple[int, int]) -> None:
        repeat, fold = at
        mine = placed.where(F.col("repeat") == repeat)
        models = recipe.fit_all(mine.where(F.col("fold") != fold), candidates)
        for number, model in enumerate(models):
            part = scored(model, mine.where(F.col("fold") == fold), columns)
            part.write.parquet(f"{path}/candidate={number}/repeat={repeat}/fold={fold}")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(fit_and_score), at) for at in numbers]:
            done.result()
    return spark.read.parquet(path)


def fold_values(scores: DataFrame, scorer: str, keys: Sequence[str] = ("candidate", "fold")) -> DataFrame:
    """``keys, value``: a weighted scorer for every candidate and fold, by block scans over all of them at once.

    Balanced accuracy and the correlation take a row as positive above a score of one half; the correlation is 0 where
    it is undefined. The others are NULL in a fold that lacks a class.
    """
    keys = list(keys)
    if scorer == "auroc":
        return metrics.auroc(scores, "y", "score", "w", keys, out="value")
    if scorer == "average_prec":
        return metrics.average_precision(scores, "y", "score", "w", keys, out="value")
    if scorer == "partial_auroc_weighted":
        return metrics.partial_auroc(scores, "y", "score", PARTIAL_LIMIT, "w", keys).withColumnRenamed("partial_auroc", "value")
    if scorer in ("balanced_accuracy", "matthews_corrcoef"):
        cells = metrics.confusion(scores, "y", (F.col("score") > 0.5).cast("int"), "w", keys)
        table = metrics.rates(cells)
        both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
        value = F.when(both, F.col("balanced_accuracy")) if scorer == "balanced_accuracy" else F.coalesce("mcc", F.lit(0.0))
        return table.select(*keys, value.alias("value"))
    raise ValueError(f"unknown scorer {scorer}; known are {SCORERS}")


def candidate_means(scores: DataFrame, scorer: str) -> DataFrame:
    """``candidate, mean_value, folds``: the mean over the folds, NULL if the value of a fold is."""
    values = fold_values(scores, scorer)
    return values.groupBy("candidate").agg(F.when(F.count("value") == F.count(F.lit(1)), F.avg("value")).alias("mean_value"), F.count(F.lit(1)).alias("folds"))


@dataclass
class Search:
    """The outcome of a search: the number and parameters of the best candidate, means, and the scores they come from."""

    best: int
    params: dict
    means: DataFrame
    scores: DataFrame

    def out_of_fold(self) -> DataFrame:
        """Every row once, scored by the best candidate fitted on other persons: the folds of the first repeat."""
        return self.scores.where((F.col("candidate") == self.best) & (F.col("repeat") == 0)).drop("candidate", "repeat")


def search(
    rows: DataFrame, person: str, recipe: Recipe, candidates: Sequence[Params], inner: int, repeats: int = 1, scorer: str = "auroc", seed: int = 42,
    keep: Sequence[str] = (), parallelism: int = 4,
) -> Search:
    """Grid search over repeated folds that keep persons together; the first of equally good candidates (to nine digits) wins."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer}; known are {SCORERS}")
    folds = sampling.repeated_folds(rows, person, ["y"], inner, repeats, seed)
    scores = cross_fit(rows, person, folds, recipe, candidates, keep, parallelism)
    means = candidate_means(scores, scorer)
    # One row for each candidate.
    table = [(round(r["mean_value"], 9), -r["candidate"]) for r in means.collect() if r["mean_value"] is not None]
    if not table:
        raise contracts.ContractError(f"{scorer} is undefined in a fold of every candidate")
    best = -max(table)[1]
    return Search(best, dict(candidates[best]), means, scores)


def out_of_fold(rows: DataFrame, person: str, recipe: Recipe, params: Params, folds: int, seed: int = 42, keep: Sequence[str] = (), parallelism: int = 4) -> DataFrame:
    """Every row scored once by a model fitted on other persons: folds of one repeat are a partition."""
    placed = sampling.repeated_folds(rows, person, ["y"], folds, 1, seed)
    return cross_fit(rows, person, placed, recipe, [params], keep, parallelism).drop("candidate", "repeat")


def threshold_from_scores(scores: DataFrame, weight: str | None, rule: str = "fpr", alpha: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, threshold``: highest TPR at an FPR up to ``alpha``, or highest balanced accuracy, from weighted ROC rows."""
    points = metrics.roc_points(scores, "y", "score", weight, keys)
    if rule == "fpr":
        return metrics.threshold_at_fpr(points, alpha, keys)
    if rule == "balanced_accuracy":
        return metrics.threshold_at_balanced_accuracy(points, keys)
    raise ValueError(f"unknown rule {rule}")


def population_weights(rows: DataFrame, age: str | None, sex: str | None, out: str = "population_weight", keys: Sequence[str] = ()) -> DataFrame:
    """Strata weights towards the target population, or equal weights without age and sex."""
    if age is None or sex is None:
        return rows.withColumn(out, F.lit(1.0))
    return weights.strata_weights(rows, "y", age, sex, out, keys=keys).drop("band")
