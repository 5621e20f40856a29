"""Class, overlap and post-stratification weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.functions import vocabulary as V
from pairwell.operators.propensity import fit_logistic, score_logistic
from pairwell.operators.scan import column_medians, exact_percentiles, measured_join, null_safe_join


def class_weights(df: DataFrame, label: str, out: str, prevalence: float | None = None) -> DataFrame:
    """Balanced weights, or weights that move the sample to a target prevalence."""
    pi = df.agg(F.avg(F.col(label).cast("double")).alias("pi")).scalar()
    up, down = (0.5, 0.5) if prevalence is None else (prevalence, 1 - prevalence)
    return df.withColumn(
        out, F.when(F.col(label) == 1, up / (pi + 1e-12)).otherwise(down / (1 - pi + 1e-12))
    )


def overlap_weights(
    df: DataFrame,
    label: str,
    covariates: Sequence[str],
    out: str,
    C: float = 1.0,
    clip_ps: tuple[float, float] = (0.05, 0.95),
    max_weight: float | None = 10.0,
) -> DataFrame:
    """``1 - p`` for cases and ``p`` for controls, p from an L2 logistic model on filled covariates."""
    used = [c for c in covariates if c in df.columns]
    if not used:
        return df.withColumn(out, F.lit(1.0))
    medians = column_medians(df.select([E.to_number(F.col(c)).alias(c) for c in used]), used)
    filled = {f"_x_{c}": F.coalesce(E.to_number(F.col(c)), F.lit(medians[c])) for c in used if medians[c] is not None}
    prepared = df.withColumns(filled)
    model = fit_logistic(prepared, label, list(filled), C=C)
    scored = score_logistic(model, prepared, list(filled), "_p")
    p = E.clip(F.col("_p"), *clip_ps)
    w = F.when(F.col(label) == 1, 1 - p).otherwise(p)
    if max_weight is not None:
        w = E.clip(w, 1e-6, max_weight)
    return scored.withColumn(out, w).drop("_p", *filled)


def band_levels(
    labels: Sequence[str] = V.COARSE_LABELS, shares: Sequence[float] = V.COARSE_SHARES
) -> list[tuple[dict[str, str], dict[str, float]]]:
    """For each number of merges of the two lowest bands: band mapping and share per merged band."""
    names = list(labels)
    mapping = {label: label for label in labels}
    share = dict(zip(labels, shares))
    levels = [(dict(mapping), dict(share))]
    while len(names) >= 2:
        low, high = names[0], names[1]
        merged = "<=75" if (low, high) == ("<=65", "66-75") else f"{low}+{high}"
        mapping = {k: merged if v in (low, high) else v for k, v in mapping.items()}
        share = {merged: share[low] + share[high], **{k: v for k, v in share.items() if k not in (low, high)}}
        names = [merged, *names[2:]]
        levels.append((dict(mapping), dict(share)))
    return levels


def merge_level(
    cells: DataFrame, label: str, band: str, sex: str, count: str, min_controls: int, labels, shares, keys: Sequence[str]
) -> DataFrame:
    """Per key, the fewest merges after which every stratum with controls has enough of them.

    A stratum without any control never asks for a merge. If no level suffices, all bands merge.
    """
    levels = band_levels(labels, shares)
    names = {f"{i}|{b}": m for i, (mapping, _) in enumerate(levels) for b, m in mapping.items()}
    tried = cells.where(F.col(label) == 0).withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(len(levels))])))
    tried = tried.withColumn("_merged", E.lookup(F.concat_ws("|", F.col("_level"), F.col(band)), names))
    strata = tried.groupBy(*keys, "_level", "_merged", sex).agg(F.sum(count).alias("_c"))
    worst = strata.groupBy(*keys, "_level").agg(F.min("_c").alias("_c"))
    enough = F.min(F.when(F.col("_c") >= min_controls, F.col("_level")))
    return worst.groupBy(*keys).agg(F.coalesce(enough, F.lit(len(levels) - 1)).alias("_level"))


def strata_weights(
    df: DataFrame,
    label: str,
    age: str,
    sex: str,
    out: str = "strata_weight",
    min_controls: int = 2,
    keys: Sequence[str] = (),
    clip_at: tuple[float, float] | None = (1.0, 99.0),
    edges: Sequence[float] = V.COARSE_EDGES,
    labels: Sequence[str] = V.COARSE_LABELS,
    shares: Sequence[float] = V.COARSE_SHARES,
) -> DataFrame:
    """Post-stratification to the target population by age band and sex, independently per key.

    Rows are counted once per (key, label, band, sex). Band merges, weights and clipping limits follow
    from that small table, which is then joined back.
    """
    levels = band_levels(labels, shares)
    names = {f"{i}|{b}": m for i, (mapping, _) in enumerate(levels) for b, m in mapping.items()}
    targets = {f"{i}|{m}": v for i, (_, share) in enumerate(levels) for m, v in share.items()}
    banded = df.withColumn("_band", E.band(F.col(age), edges, labels))
    cell = [*keys, label, "_band", sex]
    counted = banded.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    group = [*keys, "_all"]
    chosen = merge_level(counted, label, "_band", sex, "_n", min_controls, labels, shares, group)
    leveled = null_safe_join(counted, chosen, group, "left").fillna({"_level": 0})
    leveled = leveled.withColumn("band", E.lookup(F.concat_ws("|", F.col("_level"), F.col("_band")), names))
    share = E.lookup(F.concat_ws("|", F.col("_level"), F.col("band")), targets)
    sex_share = F.when(F.col(sex) == 1, V.SHARE_MALE).when(F.col(sex) == 0, V.SHARE_FEMALE)
    fallback = 1.0 / (2 * (len(levels) - F.col("_level")))
    stratum = F.sum("_n").over(Window.partitionBy(*group, label, "band", sex))
    whole = F.sum("_n").over(Window.partitionBy(*group, label))
    weighted = leveled.withColumn(out, F.coalesce(share * sex_share, fallback) / (stratum / whole))
    if clip_at is not None:
        low, high = clip_at
        limits = exact_percentiles(weighted, out, {"_low": low / 100, "_high": high / 100}, group, bounds=[], count="_n")
        weighted = null_safe_join(weighted, limits, group)
        weighted = weighted.withColumn(out, E.clip(F.col(out), F.col("_low"), F.col("_high")))
    return measured_join(banded, weighted.select(*cell, "band", out), cell).drop("_band")


def clip_percentiles(
    df: DataFrame, column: str, low: float = 1.0, high: float = 99.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Force a column between two of its exact percentiles, per key."""
    limits = exact_percentiles(df, column, {"_low": low / 100, "_high": high / 100}, keys)
    if keys:
        joined = measured_join(df, limits, list(keys))
    else:
        joined = df.withColumns(
            {"_low": limits.select("_low").scalar(), "_high": limits.select("_high").scalar(), "n": F.lit(0)}
        )
    return joined.withColumn(column, E.clip(F.col(column), F.col("_low"), F.col("_high"))).drop("_low", "_high", "n")


def ess(weight: Column) -> Column:
    """Effective sample size as an aggregate: (sum w)^2 / sum w^2, 0 if that has no meaning."""
    squares = F.sum(weight * weight)
    return F.when(squares > 0, F.pow(F.sum(weight), 2) / squares).otherwise(0.0)


def per_person(df: DataFrame, weight: str, person: str) -> DataFrame:
    """Divide each weight by the number of rows of its person (counts join, not a window)."""
    siblings = df.groupBy(person).agg(F.count(F.lit(1)).alias("_siblings"))
    joined = null_safe_join(df, siblings, [person])
    return joined.withColumn(weight, F.col(weight) / F.col("_siblings")).drop("_siblings")


def fold_weights(
    df: DataFrame,
    strategy: str,
    label: str,
    person: str,
    out: str = "weight",
    covariates: Sequence[str] = ("age", "sex"),
    age: str = "age",
    sex: str = "sex",
    min_controls: int = 2,
) -> DataFrame:
    """Training weights by strategy name, shared out over the rows of each person."""
    if strategy == "flat":
        weighted = df.withColumn(out, F.lit(1.0))
    elif strategy == "class_only":
        weighted = class_weights(df, label, out)
    elif strategy == "ps_overlap":
        raw = overlap_weights(df, label, covariates, out, C=0.1)
        size = raw.agg(ess(F.col(out)).alias("e")).scalar()
        weighted = raw.withColumn(out, F.when(size < 20, 1.0).otherwise(F.col(out)))
    elif strategy == "overlap_ps_and_deploy":
        weighted = overlap_weights(df, label, covariates, out, C=1.0)
    elif strategy == "strata_only":
        weighted = strata_weights(df, label, age, sex, out, min_controls).drop("band")
    else:
        raise ValueError(f"unknown weight strategy: {strategy}")
    return per_person(weighted, out, person)


def weight_shares(df: DataFrame, label: str, weight: str, age: str, over: float = 65, keys: Sequence[str] = ()):
    """ESS, counts and the share of weight and persons above an age, per class and overall."""
    w, old = F.col(weight), F.col(age) > over
    columns = []
    for name, y in (("case", 1), ("control", 0)):
        member = F.col(label) == y
        mine = F.when(member, w)
        columns += [
            ess(mine).alias(f"ess_{name}"),
            F.count_if(member).alias(f"n_{name}"),
            (F.sum(F.when(member & old, w).otherwise(0.0)) / F.sum(mine)).alias(f"share_weight_over_{name}"),
            (F.count_if(member & old) / F.count_if(member)).alias(f"share_persons_over_{name}"),
        ]
    columns += [
        (F.sum(F.when(old, w).otherwise(0.0)) / F.sum(w)).alias("share_weight_over_all"),
        (F.count_if(old) / F.count(F.lit(1))).alias("share_persons_over_all"),
    ]
    return df.groupBy(*keys).agg(*columns)
