"""Feature preparation as a Spark ML estimator: median fill, variance limit, weighted scale, projection per block.

As an estimator it is fitted wherever a model is fitted, so the inner folds of a search prepare their own rows.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
#: The driver decomposes a covariance matrix in a library that must not run in two threads at a time.
DECOMPOSITION = threading.Lock()


def dimension_medians(df: DataFrame, vector: str, bins: int = BINS) -> list[float | None]:
    """Exact median of every dimension, None where a dimension has no value.

    The cells of the vectors are only counted: each round splits the bracket around a middle rank into equal bins,
    with the count, the smallest and the largest value of each, and goes on with the values in the bin of the rank.
    Counts are combined before the shuffle, so a task sends a row for each dimension and bin, not one for each cell. A
    bracket ends at a single value; every round puts its smallest and largest value into different bins, so it ends.
    """
    cells = df.select(F.posexplode(vector).alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))
    cells = cells.where(F.col("v").isNotNull() & ~F.isnan("v"))
    width = df.agg(F.max(F.size(vector)).alias("w")).first()["w"] or 0
    limits = cells.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    found: dict[tuple[int, int], float] = {}
    ranks = {r["dim"]: ((r["n"] - 1) // 2, r["n"] // 2) for r in limits}
    # (dim, rank) -> values below the bracket, its ends; two rows for each dimension at most.
    open_ = {(r["dim"], k): (0, r["lo"], r["hi"]) for r in limits for k in set(ranks[r["dim"]])}
    while True:
        found |= {key: lo for key, (_, lo, hi) in open_.items() if lo == hi}
        rows = [(dim, rank, below, lo, hi) for (dim, rank), (below, lo, hi) in open_.items() if lo != hi]
        if not rows:
            break
        brackets = df.sparkSession.createDataFrame(rows, "dim int, rank long, below long, lo double, hi double")
        near = cells.join(F.broadcast(brackets), "dim").where((F.col("lo") <= F.col("v")) & (F.col("v") <= F.col("hi")))
        # Halves, since the difference of two doubles may not be one.
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        inner = F.least(F.lit(bins - 2), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * bins)).cast("int")
        spot = F.when(F.col("v") == F.col("hi"), bins - 1).otherwise(inner)
        keys = ["dim", "rank", "below"]
        counted = near.groupBy(*keys, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most ``bins`` rows for each bracket.
        order = Window.partitionBy("dim", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("under", F.col("below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        chosen = placed.where((F.col("under") <= F.col("rank")) & (F.col("rank") < F.col("under") + F.col("n")))
        open_ = {(r["dim"], r["rank"]): (r["under"], r["lo"], r["hi"]) for r in chosen.select("dim", "rank", "under", "lo", "hi").collect()}
    return [(found[d, ranks[d][0]] + found[d, ranks[d][1]]) / 2 if d in ranks else None for d in range(width)]


def block_slice(positions: Sequence[int]) -> Column:
    """The kept dimensions of a block lie next to each other in the scaled vector."""
    if not positions:
        return F.array().cast("array<double>")
    return F.slice("_scaled", positions[0] + 1, len(positions))


@dataclass
class Preparation:
    """Fitted preprocessing: medians, kept dimensions, scale, and a projection per block."""

    medians: list[float | None]
    kept: list[int]
    mean: list[float]
    scale: list[float]
    blocks: list[tuple[list[int], Transformer | None]]
    sizes: list[int] = field(default_factory=list)

    def scaled(self, vector: Column) -> Column:
        """Kept dimensions, filled and standardized; the fitted numbers are one array literal."""
        table = F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.lit(self.medians[i]).alias("d"), F.lit(m).alias("m"), F.lit(s).alias("s"))
                for i, m, s in zip(self.kept, self.mean, self.scale)
            ]
        )
        value = lambda t: F.coalesce(F.nanvl(F.get(vector, t["i"]).cast("double"), F.lit(None).cast("double")), t["d"])
        return F.transform(table, lambda t: (value(t) - t["m"]) / t["s"])

    def apply(self, df: DataFrame, vector: str, out: str = "features") -> DataFrame:
        done = df.withColumn("_scaled", self.scaled(F.col(vector)))
        parts = []
        for b, (positions, projection) in enumerate(self.blocks):
            piece = block_slice(positions)
            if projection is not None:
                done = projection.transform(done.withColumn("_in", array_to_vector(piece))).drop("_in")
                done = done.withColumnRenamed("_out", f"_p{b}")
                piece = vector_to_array(f"_p{b}")
            parts.append(piece)
        done = done.withColumn(out, array_to_vector(F.concat(*parts)))
        return done.drop("_scaled", *[f"_p{b}" for b in range(len(self.blocks))])


def fit_preparation(
    df: DataFrame,
    vector: str,
    block_sizes: Sequence[int],
    components: Mapping[int, int] = {},
    weight: str | None = None,
    minimum_variance: float = 0.01,
) -> Preparation:
    """Median fill, variance above a limit, weighted standardization, PCA per block.

    The blocks follow each other in the vector; ``components`` names the blocks to project. A block keeps its columns
    as they are if it has no more of them than components asked for. A dimension without any value is dropped and the
    others keep their places. Fit this on training rows only.
    """
    medians = dimension_medians(df, vector)
    fill = F.array(*[F.lit(0.0 if m is None else m) for m in medians])
    # Vectors shorter than the widest are filled up, so that all are summed alike.
    places = F.sequence(F.lit(0), F.lit(len(medians) - 1))
    value = lambda i: F.nanvl(F.get(F.col(vector), i).cast("double"), F.lit(None).cast("double"))
    filled = F.transform(places, lambda i: F.coalesce(value(i), F.get(fill, i)))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    base = df.select(array_to_vector(filled).alias("v"), w.alias("w"))
    facts = base.agg(
        Summarizer.metrics("variance", "count").summary(F.col("v")).alias("plain"),
        Summarizer.metrics("mean", "variance").summary(F.col("v"), F.col("w")).alias("weighted"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"),
    ).first()
    n = facts["plain"]["count"]
    population = np.array(facts["plain"]["variance"].toArray()) * (n - 1) / n
    kept = [i for i, v in enumerate(population) if v > minimum_variance and medians[i] is not None]
    if not kept:
        raise ValueError("no dimension varies enough")
    # The summarizer's weighted variance is the reliability-weighted one; turn it into the population form.
    sw, sww = facts["sw"], facts["sww"]
    variance = facts["weighted"]["variance"].toArray() * (sw - sww / sw) / sw
    scale = [float(np.sqrt(variance[i])) or 1.0 for i in kept]
    mean = [float(facts["weighted"]["mean"].toArray()[i]) for i in kept]
    edges = np.cumsum([0, *block_sizes])
    blocks: list[tuple[list[int], Transformer | None]] = []
    prepared = Preparation(medians, kept, mean, scale, blocks)
    ready = df.withColumn("_scaled", prepared.scaled(F.col(vector)))
    for b in range(len(block_sizes)):
        positions = [p for p, i in enumerate(kept) if edges[b] <= i < edges[b + 1]]
        wanted = components.get(b)
        projection = None
        if wanted is not None and positions and wanted < min(len(positions), n):
            block = ready.select(array_to_vector(block_slice(positions)).alias("_in"))
            with DECOMPOSITION:
                projection = PCA(k=wanted, inputCol="_in", outputCol="_out").fit(block)
        blocks.append((positions, projection))
        prepared.sizes.append(wanted if projection is not None else len(positions))
    return prepared


class BlockPreparation(Estimator):
    """``fit_preparation`` for pipelines and searches; the projections are a parameter that a grid may vary."""

    components = Param(Params._dummy(), "components", "number of components for each block to project")

    def __init__(self, vector: str, block_sizes: Sequence[int], components: Mapping[int, int] = {}, weight: str | None = None, minimum_variance: float = 0.01, out: str = "features"):
        super().__init__()
        self.vector, self.block_sizes, self.weight = vector, list(block_sizes), weight
        self.minimum_variance, self.out = minimum_variance, out
        self._set(components=dict(components))

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        fitted = fit_preparation(dataset, self.vector, self.block_sizes, self.getOrDefault("components"), self.weight, self.minimum_variance)
        return PreparationModel(fitted, self.vector, self.out)


class PreparationModel(Model):
    def __init__(self, preparation: Preparation, vector: str, out: str):
        super().__init__()
        self.preparation, self.vector, self.out = preparation, vector, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.preparation.apply(dataset, self.vector, self.out)
