"""Run stores: a folder tree with one small text file per parameter, metric and tag.

Layout: ``<experiment>/<run>/meta.yaml`` and ``<experiment>/<run>/<params|metrics|tags>/<key>``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.functions import vocabulary as V
from pairwell.session import durable

LAYOUT = r"([^/]+)/([^/]+)/(?:(params|metrics|tags)/([^/]+)|(meta)\.yaml)$"


def scan(spark: SparkSession, paths: Sequence[str] | str, layout: str = LAYOUT) -> DataFrame:
    """Every file as a row: experiment, run_id, kind (params, metrics, tags, meta), key, text."""
    reader = spark.read.option("recursiveFileLookup", True)
    files = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    part = lambda i: F.regexp_extract("path", layout, i)
    kind = F.when(part(5) == "meta", "meta").otherwise(part(3))
    return files.where(F.col("path").rlike(layout)).select(
        part(1).alias("experiment"), part(2).alias("run_id"), kind.alias("kind"), part(4).alias("key"), "text"
    )


def meta_field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^{name}:\s*'?([^'\n]*?)'?\s*$", 1)


def last_value(text: Column) -> Column:
    """Second word of the last line of a metric file."""
    lines = F.split(F.trim(F.regexp_replace(text, r"[\r\n]+$", "")), r"\n")
    return F.get(F.split(F.trim(F.element_at(lines, -1)), r"\s+"), F.lit(1))


def run_attributes(files: DataFrame) -> DataFrame:
    """Long table: experiment, run_id, name (``params.x``, ``metrics.x``, ``tags.x``), value."""
    rows = files.where("kind <> 'meta'")
    value = F.when(F.col("kind") == "metrics", last_value(F.col("text"))).otherwise(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    return rows.select("experiment", "run_id", F.concat_ws(".", "kind", "key").alias("name"), value.alias("value")).where(
        "value is not null"
    )


def run_states(files: DataFrame) -> DataFrame:
    """Status and times from the meta files; numeric states get their names."""
    meta = files.where("kind = 'meta'")
    raw = meta_field(F.col("text"), "status")
    status = raw
    for number, name in V.RUN_STATES.items():
        status = F.when(raw == str(number), name).otherwise(status)
    stamp = lambda n: meta_field(F.col("text"), n).try_cast("long").alias(n)
    return meta.select("experiment", "run_id", status.alias("status"), stamp("start_time"), stamp("end_time"))


def run_table(files: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One wide row per finished or running run that logged a primary metric.

    Metric columns are numbers. Without a name list the column names are read from the store.
    """
    attributes = run_attributes(files)
    primary = attributes.where(F.col("name").isin("metrics.weighted_auroc_mean", "metrics.auroc_mean"))
    keep = run_states(files).where(F.col("status").isin("FINISHED", "RUNNING")).join(
        primary.select("experiment", "run_id"), ["experiment", "run_id"], "left_semi"
    )
    pivot = attributes.groupBy("experiment", "run_id")
    pivot = pivot.pivot("name", list(names)) if names else pivot.pivot("name")
    wide = pivot.agg(F.first("value"))
    numbers = {c: F.col(f"`{c}`").try_cast("double") for c in wide.columns if c.startswith("metrics.")}
    return keep.join(wide.withColumns(numbers), ["experiment", "run_id"], "left")


def export_runs(spark: SparkSession, generations: Sequence[str], layout: str = LAYOUT) -> DataFrame:
    """Runs of several generations of one experiment in one table; columns may differ.

    The many small files are read once; the wide table is then built from the stored copy.
    """
    out = None
    for path in generations:
        table = run_table(durable(scan(spark, path, layout)))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def metric_history(files: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Values of each metric file ordered by step; malformed lines are skipped."""
    rows = files.where((F.col("kind") == "metrics") & F.col("key").isin(*metrics))
    lines = rows.select("experiment", "run_id", "key", F.explode(F.split("text", r"\n")).alias("line"))
    words = F.split(F.trim("line"), r"\s+")
    step = F.get(words, F.lit(2)).try_cast("long")
    value = F.get(words, F.lit(1)).try_cast("double")
    parsed = lines.select("experiment", "run_id", "key", step.alias("step"), value.alias("value")).where(
        "step is not null and value is not null"
    )
    lists = parsed.groupBy("experiment", "run_id", "key").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("_l"))
    listed = lists.select("experiment", "run_id", "key", F.transform("_l", lambda s: s["value"]).alias("values"))
    seen = rows.select("experiment", "run_id", "key").distinct()
    return seen.join(listed, ["experiment", "run_id", "key"], "left").withColumn(
        "values", F.coalesce("values", F.array().cast("array<double>"))
    )


def first_experiment(histories: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Of several folders that hold a run's metric, the first in priority order counts."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("experiment"))
    w = Window.partitionBy("run_id", "key").orderBy(rank)
    known = histories.where(F.col("experiment").isin(*priority))
    return known.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def log_matches(logs: DataFrame, pattern: str, out: str) -> DataFrame:
    """First capture of a pattern in each run's log text; NULL if it does not occur."""
    hit = F.regexp_extract("text", pattern, 1)
    return logs.select("run_id", F.when(hit != "", hit).alias(out))


def run_info(table: DataFrame, columns: Mapping[str, str], logs: DataFrame | None = None) -> DataFrame:
    """Chosen attributes per run under short names, with the hyperparameter grid and log covariates."""
    solver = "params.classifier_hyperparams.clf__solver"
    chosen = [F.col(f"`{c}`").alias(n) for n, c in columns.items() if c in table.columns]
    lr = F.col("`params.classifier_name`") == "LogisticRegression"
    small = F.col(f"`{solver}`") == "['lbfgs']" if solver in table.columns else F.lit(False)
    grid = F.when(lr & F.coalesce(small, F.lit(False)), "lr_baseline").otherwise("extended")
    info = table.select("run_id", *chosen, grid.alias("grid"))
    if logs is None:
        return info
    return info.join(log_matches(logs, r"covariates used: (\[.*?\])", "overlap_covariates_logged"), "run_id", "left")
