"""Aggregations, pivots and other changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.scan import exact_percentiles, null_safe_join


def pool_chunks(df: DataFrame, person: str, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Chunk scores to person scores by their mean. Labels must be constant (see ``label_conflicts``)."""
    return df.groupBy(*keys, person).agg(F.max(label).alias(label), F.avg(score).alias(score))


def pool_folds(df: DataFrame, person: str, label: str, score: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Person-level label, mean score and mean weight over repeats and runs."""
    return df.groupBy(*keys, person).agg(
        F.max(label).cast("int").alias("y"), F.avg(score).alias("p"), F.avg(weight).alias("w")
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd of each metric over the folds where it is finite."""
    columns = []
    for m in metrics:
        finite = F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
        columns += [F.avg(finite).alias(f"{m}_mean"), F.stddev_pop(finite).alias(f"{m}_std")]
    return folds.groupBy(*keys).agg(*columns)


def fold_stats(fold_metrics: DataFrame, scores: DataFrame, score: str, keys: Sequence[str], fold: str) -> DataFrame:
    """Number of folds, folds with one constant score, mean and sample sd of both AUROCs."""
    constant = scores.groupBy(*keys, fold).agg((F.min(score) == F.max(score)).alias("constant"))
    joined = null_safe_join(fold_metrics, constant, [*keys, fold])
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if("constant").alias("n_constant_folds"),
        F.avg("weighted_auroc").alias("fold_wauroc_mean"),
        F.stddev_samp("weighted_auroc").alias("fold_wauroc_sd"),
        F.avg("auroc").alias("fold_auroc_mean"),
        F.stddev_samp("auroc").alias("fold_auroc_sd"),
    )


def fold_difference_sd(a: DataFrame, b: DataFrame, fold: str, metric: str, membership_differences: DataFrame):
    """Sample sd over folds of the metric difference; NULL unless both runs used the same folds."""
    same = membership_differences.agg(F.count(F.lit(1)) == 0).scalar()
    joined = a.select(fold, F.col(metric).alias("_a")).join(b.select(fold, F.col(metric).alias("_b")), fold)
    return joined.agg(F.stddev_samp(F.col("_a") - F.col("_b")).alias("sd"), F.count(F.lit(1)).alias("n")).select(
        F.when(same, F.col("sd")).alias("fold_diff_sd"), "n"
    )


def seed_summary(df: DataFrame, keys: Sequence[str], seed: str = "seed", fixed_seed: int = 42) -> DataFrame:
    """Spread of the results over seeds, next to the results of one named seed."""
    at = lambda c: F.max(F.when(F.col(seed) == fixed_seed, F.col(c)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        at("wauroc").alias("seed_wauroc"),
        at("wauroc_lo").alias("seed_lo"),
        at("wauroc_hi").alias("seed_hi"),
        F.avg("wauroc").alias("wauroc_mean"),
        F.min("wauroc").alias("wauroc_min"),
        F.max("wauroc").alias("wauroc_max"),
        F.count_if(F.col("wauroc") < 0.5).alias("n_below_half"),
        F.avg("diff").alias("diff_mean"),
        F.count_if(F.col("diff_lo") > 0).alias("n_diff_above_0"),
    )


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns to rows; NULL values are dropped and absent columns ignored."""
    present = [c for c in columns if c in df.columns]
    return df.unpivot(list(ids), present, name, value).where(F.col(value).isNotNull())


def crosstab(df: DataFrame, row: str, column: str, margin: str = "All") -> DataFrame:
    """Counts per cell with both margins and the share of each row, in long form."""
    base = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = base.groupBy(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("col")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The cell table is as small as the two vocabularies; margins are sums over it.
    cube = cells.cube("row", "col").agg(
        F.sum("n").alias("n"), F.grouping("row").alias("gr"), F.grouping("col").alias("gc")
    )
    out = cube.select(
        F.when(F.col("gr") == 1, margin).otherwise(F.col("row")).alias("row"),
        F.when(F.col("gc") == 1, margin).otherwise(F.col("col")).alias("col"),
        "n",
    )
    total = F.sum(F.when(F.col("col") == margin, F.col("n"))).over(Window.partitionBy("row"))
    return out.withColumn("row_pct", F.col("n") * 100.0 / total)


def matrix(df: DataFrame, row: str, column: str, columns: Sequence[str], value: str, how: str = "best") -> DataFrame:
    """Display matrix of a metric: best, mean, or mean with sample sd, three decimals."""
    if how == "best":
        cell = F.format_string("%.3f", F.max(value))
    elif how == "mean":
        cell = F.format_string("%.3f", F.avg(value))
    else:
        cell = F.format_string("%.3f +/- %.3f", F.avg(value), F.stddev_samp(value))
    cell = F.when(F.count(value) > 0, cell)
    return df.where(F.col(value).isNotNull()).groupBy(row).pivot(column, list(columns)).agg(cell)


def paired_delta(df: DataFrame, key: Sequence[str], axis: str, first: str, second: str, value: str) -> DataFrame:
    """Summary of ``second - first`` over the configurations that have both."""
    pick = lambda v: F.first(F.when(F.col(axis) == v, F.col(value)), ignorenulls=True)
    pairs = df.groupBy(*key).agg(pick(first).alias("_a"), pick(second).alias("_b")).na.drop(subset=["_a", "_b"])
    delta = F.col("_b") - F.col("_a")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(delta).alias("delta_mean"),
        F.stddev_samp(delta).alias("delta_sd"),
        F.count_if(delta > 0).alias("n_positive"),
        F.count_if(delta < 0).alias("n_negative"),
    )


def level_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.max(value).alias("best"),
    )


def argmax_rows(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Row with the largest value per key; partial aggregation keeps one row per key and task."""
    rest = [c for c in df.columns if c not in keys]
    from pairwell.operators.cohort import keep_first

    return keep_first(df.where(F.col(value).isNotNull()), keys, [F.col(value).desc(), *tie]).select(*keys, *rest)


def token_counts(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Counts of the tokens of a delimited text, NULL included."""
    tokens = F.explode_outer(F.split(F.col(column), separator)).alias("token")
    return df.select(tokens).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def explode_parallel(df: DataFrame, keys: Sequence[str], lists: Sequence[str], names: Sequence[str]) -> DataFrame:
    """List columns side by side, with their position; lists of unequal length are an error."""
    first = F.size(lists[0])
    same = F.lit(True)
    for other in lists[1:]:
        same = same & (F.size(other) == first)
    zipped = F.when(same, F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(lists, names)])).otherwise(
        F.raise_error(F.lit("lists of unequal length"))
    )
    wide = df.where(first > 0).select(*keys, F.posexplode(zipped).alias("pos", "_z"))
    return wide.select(*keys, "pos", *[F.col(f"_z.{n}").alias(n) for n in names])


def strata_columns(df: DataFrame, keys: Sequence[str], marker: str = "stratum", suffix: str = "_mean") -> DataFrame:
    """Columns of per-stratum means to rows of (stratum, value)."""
    columns = [c for c in df.columns if marker in c and c.endswith(suffix)]
    long = df.unpivot(list(keys), columns, "stratum", "value")
    name = F.replace(F.replace("stratum", F.lit("auroc_stratum_")), F.lit(suffix))
    return long.withColumn("stratum", name)


def dataset_summary(df: DataFrame, person: str, label: str, checked: Sequence[str]) -> DataFrame:
    """Rows, persons and NULL counts in one pass, one row per figure."""
    names = ["rows", "persons", *[f"null_{c}" for c in checked]]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(person).alias("persons"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in checked],
    )
    figures = row.unpivot([], names, "figure", "n")
    classes = df.groupBy(F.concat(F.lit("class_"), F.col(label).cast("string")).alias("figure")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return figures.unionByName(classes)


def describe_groups(df: DataFrame, group: str, continuous: Sequence[str]) -> DataFrame:
    """Count, mean and sample sd of each continuous column per group, in long form."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in continuous]).unpivot(
        [group], list(continuous), "variable", "value"
    )
    return long.where("value is not null").groupBy(group, "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def describe_flags(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    """Count and percentage of each flag per group."""
    long = df.select(group, *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in flags]).unpivot(
        [group], list(flags), "variable", "value"
    )
    return long.groupBy(group, "variable").agg(
        F.sum("value").cast("long").alias("n"), (F.avg("value") * 100).alias("pct")
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[int], keys: Sequence[str] = ()):
    """Counts for every pair of labels, zeros included."""
    cells = [
        F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias("n"))
        for t in labels
        for p in labels
    ]
    return df.groupBy(*keys).agg(F.array(*cells).alias("_c")).select(*keys, F.explode("_c").alias("c")).select(*keys, "c.*")


def accuracy(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    right = (F.col(truth) == F.col(predicted)).cast("double")
    return df.groupBy(*keys).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def class_ratio(df: DataFrame, source: str, label: str, longitudinal: str) -> DataFrame:
    """Cases and controls outside follow-up per source, and their ratio."""
    base = df.where(F.col(longitudinal) == 0)
    counts = base.groupBy(source).agg(
        F.count_if(F.col(label) == 1).alias("cases"), F.count_if(F.col(label) == 0).alias("controls")
    )
    return counts.withColumn("ratio", F.when(F.col("controls") > 0, F.col("cases") / F.col("controls")))


def sparse_strata(df: DataFrame, keys: Sequence[str], below: int = 5) -> DataFrame:
    stratum = E.composite_key([F.col(k) for k in keys]).alias("stratum")
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < below)


def fold_spread(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Median, minimum and maximum of fold figures, in long form."""
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        list(keys), list(values), "figure", "value"
    )
    by = [*keys, "figure"]
    medians = exact_percentiles(long, "value", {"median": 0.5}, by).drop("n")
    ends = long.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return null_safe_join(ends, medians, by)


def top_values(df: DataFrame, group: str, column: str, n: int = 5) -> DataFrame:
    """Most frequent values per group; ties by value."""
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), column)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def status_counts(df: DataFrame, status: str, key: str, wanted: str) -> DataFrame:
    """Runs per state, and how many of the wanted state are repeats of the same key."""
    per = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_keys"))
    return per.withColumn("n_repeats", F.when(F.col(status) == wanted, F.col("n") - F.col("n_keys")).otherwise(0)).drop("n_keys")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def pool_steps(frames: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean and sample sd per dimension over the time steps of a recording."""
    cells = frames.select(*keys, F.posexplode(vector).alias("dim", "v"))
    stats = cells.groupBy(*keys, "dim").agg(
        F.avg(F.col("v").cast("double")).alias("m"), F.stddev_samp(F.col("v").cast("double")).alias("s")
    )
    # One entry per dimension of the vector: bounded by the model width.
    rows = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("_r"))
    return rows.select(
        *keys, F.transform("_r", lambda r: r["m"]).alias("mean"), F.transform("_r", lambda r: r["s"]).alias("std")
    )
