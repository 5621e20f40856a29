"""Ranking and threshold metrics, weighted, for any number of groups in one job.

Scores are first added up per (group, score). AUROC, average precision, ROC rows and partial AUROC
then come from running sums over distinct scores, so cost grows with the rows and not with pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.scan import block_of, cumulate, null_safe_join, value_bounds


def score_mass(
    df: DataFrame, label: str, score: str, weight: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Weight of positives (``wp``) and negatives (``wn``) per group and distinct score."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    positive = F.col(label) == 1
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.when(positive, w).otherwise(0.0)).alias("wp"),
            F.sum(F.when(positive, 0.0).otherwise(w)).alias("wn"),
        )
    )


def _cumulated(df, label, score, weight, keys, bounds) -> DataFrame:
    if bounds is None:
        bounds = value_bounds(df, score)
    mass = score_mass(df, label, score, weight, keys)
    return cumulate(mass, list(keys), "score", ["wp", "wn"], bounds)


def auroc(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    out: str = "auroc",
) -> DataFrame:
    """Area under the ROC curve; tied scores count one half; NULL if a class is absent."""
    if bounds is None:
        bounds = value_bounds(df, score)
    mass = score_mass(df, label, score, weight, keys).withColumn("_blk", block_of(F.col("score"), bounds))
    return _auroc_of_blocks(mass, list(keys), out)


def aurocs(
    df: DataFrame,
    label: str,
    scores: Sequence[str],
    weight: str | None,
    keys: Sequence[str],
    bounds: dict[str, Sequence[float]],
) -> DataFrame:
    """AUROC of several scores on the same rows, one column per score; the rows are read once."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    entries = F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("score")) for s in scores])
    long = df.select(*keys, F.col(label).alias("_y"), w.alias("_w"), F.explode(entries).alias("_e")).select(
        *keys, "_y", "_w", "_e.name", F.col("_e.score").alias("_score")
    )
    block = F.lit(0)
    for s in scores:
        block = F.when(F.col("name") == s, block_of(F.col("score"), bounds[s])).otherwise(block)
    mass = score_mass(long, "_y", "_score", "_w", [*keys, "name"]).withColumn("_blk", block)
    found = _auroc_of_blocks(mass, [*keys, "name"], "auroc")
    picks = [F.max(F.when(F.col("name") == s, F.col("auroc"))).alias(s) for s in scores]
    return found.groupBy(*keys).agg(*picks)


def _auroc_of_blocks(mass: DataFrame, keys: list[str], out: str) -> DataFrame:
    """AUROC from score masses with their block.

    Pairs won inside a score block come from a running sum in that block; pairs between blocks are
    products of block totals. So one pass over the scores is enough and nothing is joined back.
    """
    inner = Window.partitionBy(*keys, "_blk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("wn").over(inner), F.lit(0.0))
    won = mass.withColumn("_won", F.col("wp") * (below + F.col("wn") / 2))
    blocks = won.groupBy(*keys, "_blk").agg(F.sum("_won").alias("_won"), F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_below", F.coalesce(F.sum("wn").over(earlier), F.lit(0.0)))
    pairs = F.sum("wp") * F.sum("wn")
    total = F.sum(F.col("_won") + F.col("wp") * F.col("_below"))
    return blocks.groupBy(*keys).agg(F.when(pairs > 0, total / pairs).alias(out))


def average_precision(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    out: str = "average_precision",
) -> DataFrame:
    """Step-wise sum of precision times the gain in recall, from the highest score down."""
    rows = _cumulated(df, label, score, weight, keys, bounds)
    tp = F.col("wp_total") - F.col("wp_before")
    fp = F.col("wn_total") - F.col("wn_before")
    step = F.when(F.col("wp_total") > 0, F.col("wp") / F.col("wp_total") * tp / (tp + fp))
    return rows.groupBy(*keys).agg(F.sum(step).alias(out))


def ranking_metrics(
    df: DataFrame,
    label: str,
    score: str,
    weights: dict[str, str | None],
    keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """AUROC and average precision under several weightings from one ordered scan.

    ``weights`` maps a name prefix to a weight column (None for equal weights).
    """
    if bounds is None:
        bounds = value_bounds(df, score)
    positive = F.col(label) == 1
    sums, values = [], []
    for i, column in enumerate(weights.values()):
        w = F.lit(1.0) if column is None else F.col(column).cast("double")
        sums += [
            F.sum(F.when(positive, w).otherwise(0.0)).alias(f"wp{i}"),
            F.sum(F.when(positive, 0.0).otherwise(w)).alias(f"wn{i}"),
        ]
        values += [f"wp{i}", f"wn{i}"]
    mass = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(*sums)
    rows = cumulate(mass, list(keys), "score", values, bounds)
    out = []
    for i, prefix in enumerate(weights):
        wp, wn = F.col(f"wp{i}"), F.col(f"wn{i}")
        tp = F.col(f"wp{i}_total") - F.col(f"wp{i}_before")
        fp = F.col(f"wn{i}_total") - F.col(f"wn{i}_before")
        pairs = F.sum(wp) * F.sum(wn)
        step = F.when(F.col(f"wp{i}_total") > 0, wp / F.col(f"wp{i}_total") * tp / (tp + fp))
        out += [
            F.when(pairs > 0, F.sum(wp * (F.col(f"wn{i}_before") + wn / 2)) / pairs).alias(f"{prefix}auroc"),
            F.sum(step).alias(f"{prefix}average_precision"),
        ]
    return rows.groupBy(*keys).agg(*out)


def roc_segments(df, label, score, weight=None, keys: Sequence[str] = (), bounds=None) -> DataFrame:
    """One row per distinct score: the ROC point before and after accepting that score."""
    rows = _cumulated(df, label, score, weight, keys, bounds).where("wp_total > 0 and wn_total > 0")
    tp1 = F.col("wp_total") - F.col("wp_before")
    fp1 = F.col("wn_total") - F.col("wn_before")
    return rows.select(
        *keys,
        "score",
        "wp",
        "wn",
        ((fp1 - F.col("wn")) / F.col("wn_total")).alias("fpr0"),
        ((tp1 - F.col("wp")) / F.col("wp_total")).alias("tpr0"),
        (fp1 / F.col("wn_total")).alias("fpr"),
        (tp1 / F.col("wp_total")).alias("tpr"),
    )


def roc_points(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    drop_collinear: bool = True,
) -> DataFrame:
    """ROC rows ``fpr, tpr, threshold`` from the infinite threshold down.

    Points in the middle of a straight stretch are dropped on request: a point goes if the next
    lower score adds the same weight to both axes as its own score did.
    """
    if bounds is None:
        bounds = value_bounds(df, score)
    rows = roc_segments(df, label, score, weight, keys, bounds)
    keys = list(keys)
    start = rows.groupBy(*keys).agg(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    if drop_collinear:
        step = F.struct("wp", "wn")
        marked = rows.withColumn("_blk", block_of(F.col("score"), bounds))
        inner = Window.partitionBy(*keys, "_blk").orderBy("score")
        marked = marked.withColumn("_next", F.lag(step).over(inner))
        heads = marked.groupBy(*keys, "_blk").agg(F.max_by(step, F.col("score")).alias("_top"))
        lower = Window.partitionBy(*keys).orderBy("_blk")
        heads = heads.select(*keys, "_blk", F.lag("_top").over(lower).alias("_below"))
        joined = null_safe_join(marked, heads, [*keys, "_blk"])
        following = F.coalesce(F.col("_next"), F.col("_below"))
        own_top = F.col("fpr0") + F.col("tpr0") == 0
        middle = following.isNotNull() & (following["wp"] == F.col("wp")) & (following["wn"] == F.col("wn"))
        rows = joined.where(~F.coalesce(middle, F.lit(False)) | own_top)
    return rows.select(*keys, "fpr", "tpr", F.col("score").alias("threshold")).unionByName(start)


def partial_auroc(
    df, label: str, score: str, max_fpr: float = 0.2, weight=None, keys: Sequence[str] = (), bounds=None
) -> DataFrame:
    """Area up to ``max_fpr``, rescaled so that chance is 0.5 and perfection is 1."""
    rows = roc_segments(df, label, score, weight, keys, bounds)
    limit = F.lit(float(max_fpr))
    width = F.col("fpr") - F.col("fpr0")
    share = F.when(width > 0, F.least(F.lit(1.0), (limit - F.col("fpr0")) / width)).otherwise(0.0)
    end_tpr = F.col("tpr0") + (F.col("tpr") - F.col("tpr0")) * share
    area = F.when(F.col("fpr0") < limit, share * width * (F.col("tpr0") + end_tpr) / 2).otherwise(0.0)
    floor = 0.5 * max_fpr * max_fpr
    total = F.sum(area)
    return rows.groupBy(*keys).agg((0.5 * (1 + (total - floor) / (max_fpr - floor))).alias("partial_auroc"))


def threshold_at_fpr(points: DataFrame, alpha: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold of the ROC point with the highest TPR among those with FPR up to ``alpha``."""
    best = F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct("tpr", "threshold"))
    return points.where(F.col("fpr") <= alpha).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def threshold_at_balanced_accuracy(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Finite threshold with the highest balanced accuracy; the higher one on ties."""
    wba = (F.col("tpr") + 1 - F.col("fpr")) / 2
    best = F.max_by(
        F.struct("threshold", wba.alias("balanced_accuracy")), F.struct(wba.alias("a"), F.col("threshold"))
    )
    finite = points.where(F.col("threshold") < float("inf"))
    return finite.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def confusion(df: DataFrame, label: str, predicted: Column, weight: str | None = None, keys: Sequence[str] = ()):
    """Weighted confusion cells ``tp, fn, fp, tn``."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cell = lambda y, p: F.sum(F.when((F.col(label) == y) & (predicted == p), w).otherwise(0.0))
    return df.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn")
    )


def rates(cells: DataFrame) -> DataFrame:
    """TPR, FPR (0 without members), balanced accuracy and MCC (NULL if undefined)."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    tpr = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    fpr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return cells.withColumns(
        {
            "tpr": tpr,
            "fpr": fpr,
            "balanced_accuracy": (tpr + 1 - fpr) / 2,
            "mcc": F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)),
        }
    )


def deployment(df: DataFrame, prevalence: float | Column = 0.2) -> DataFrame:
    """PPV, NPV and false positives per 1000 at a given prevalence, from ``tpr`` and ``fpr``."""
    pi = F.lit(prevalence) if isinstance(prevalence, (int, float)) else prevalence
    tpr, fpr = F.col("tpr"), F.col("fpr")
    hit = pi * tpr + (1 - pi) * fpr
    miss = (1 - pi) * (1 - fpr) + pi * (1 - tpr)
    usable = (pi > 0) & (pi < 1)
    return df.withColumns(
        {
            "ppv": F.when(usable & (hit > 0), pi * tpr / hit),
            "npv": F.when(usable & (miss > 0), (1 - pi) * (1 - fpr) / miss),
            "fp_per_1000": 1000.0 * (1 - pi) * fpr,
        }
    )


def stratum_auroc(df: DataFrame, label: str, score: str, age: str, sex: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC per age band and sex, where both classes and two rows are present."""
    groups = [*keys, "stratum"]
    named = df.withColumn(
        "stratum", F.concat(E.band(F.col(age)), F.lit("_sex"), F.col(sex).cast("int").cast("string"))
    )
    return auroc(named, label, score, keys=groups).where("auroc is not null")


def score_age_correlation(
    df: DataFrame, label: str, score: str, age: str, person: str, fold: str, folds_per_repeat: int = 5
) -> DataFrame:
    """Correlation of score and age among controls: per repeat over persons, then averaged."""
    controls = df.where((F.col(label) == 0) & F.col(age).isNotNull())
    repeat = F.floor((F.col(fold) - 1) / folds_per_repeat).alias("repeat")
    persons = controls.groupBy(repeat, person).agg(F.avg(score).alias("p"), F.max(age).alias("a"))
    per_repeat = persons.groupBy("repeat").agg(
        F.corr("p", "a").alias("r"), F.min("a").alias("lo"), F.max("a").alias("hi")
    )
    kept = per_repeat.where("lo < hi")
    n = controls.agg(F.countDistinct(person).alias("n"))
    return kept.agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n_repeats")).withColumn(
        "n_controls", n.scalar()
    )
