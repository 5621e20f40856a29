"""Joins and set operations between person, recording and covariate tables.

No side is broadcast by hand: Spark decides from measured sizes, and adaptive execution splits
skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.contracts import ContractError
from pairwell.operators.cohort import keep_first
from pairwell.operators.scan import block_of, null_safe_join, numbered, value_bounds


def add_covariates(df: DataFrame, covariates: DataFrame, person: str) -> DataFrame:
    """Left join of the columns that are not there yet; missing covariates count as 0."""
    key = covariates.columns[0]
    new = [c for c in covariates.columns[1:] if c not in df.columns]
    side = covariates.select(F.col(key).alias(person), *new)
    joined = df.join(side, person, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in new})


def map_ids(df: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    """Inner join to an id map, distinct rows."""
    return df.join(id_map, key).distinct()


def attach_single(main: DataFrame, dates: DataFrame, files: DataFrame, person: str = "audio_id") -> DataFrame:
    """Single recordings: persons outside follow-up, their date and their files."""
    return main.where("longitudinal = 0").join(dates, person, "left").join(files, person, "left")


def attach_longitudinal(dates: DataFrame, files: DataFrame, main: DataFrame, person: str = "audio_id") -> DataFrame:
    """Follow-up recordings: files by person and date, attributes by person."""
    attributes = main.where("longitudinal = 1").drop("date")
    return attributes.join(dates, person).join(files, [person, "date"], "left")


def bridge(df: DataFrame, lookup: DataFrame, raw_key: str, bridge_key: str, value: str, order: Sequence[str]):
    """Look a value up through a table with several rows per normalized key; the first row counts."""
    normal = lambda c: E.trim_lower(F.col(c).cast("string"))
    first = keep_first(lookup.withColumn("_k", normal(bridge_key)), ["_k"], order).select("_k", value)
    return df.withColumn("_k", normal(raw_key)).join(first, "_k", "left").drop("_k")


def map_values(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Value per key from a table with unique keys; NULL where the key is unknown."""
    return df.join(table.select(key, value), key, "left")


def align(left: DataFrame, right: DataFrame, person: str, label: str, suffixes=("_a", "_b")) -> DataFrame:
    """Persons in both score tables. Columns other than the person get a suffix."""
    a = left.select(person, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c != person])
    b = right.select(person, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c != person])
    return a.join(b, person)


def require_same_labels(aligned: DataFrame, label: str, suffixes=("_a", "_b")) -> None:
    bad = aligned.where(~F.col(label + suffixes[0]).eqNullSafe(F.col(label + suffixes[1]))).count()
    if bad:
        raise ContractError(f"{bad} persons carry different labels in the two score tables")


def keep_matched(detail: DataFrame, persons: DataFrame, person: str) -> DataFrame:
    return detail.join(persons.select(person), person, "left_semi")


def drop_held_out(detail: DataFrame, held_out: DataFrame, person: str) -> DataFrame:
    return detail.join(held_out.select(person), person, "left_anti")


def nearest_values(wanted: DataFrame, offered: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distance (``gap``) from each wanted value to the nearest offered one of the same key.

    Both frames hold distinct (keys, value). Values are laid on one line per key and the last offered
    value below and the first above are carried along, block by block; nothing is paired.
    """
    line = wanted.select(*keys, value, F.lit(True).alias("_w"), F.lit(False).alias("_o")).unionByName(
        offered.select(*keys, value, F.lit(False).alias("_w"), F.lit(True).alias("_o"))
    )
    line = line.groupBy(*keys, value).agg(F.max("_w").alias("_w"), F.max("_o").alias("_o"))
    bounds = value_bounds(line, value)
    line = line.withColumn("_blk", block_of(F.col(value), bounds))
    part = [*keys, "_blk"]
    mine = F.when(F.col("_o"), F.col(value))
    up = Window.partitionBy(*part).orderBy(value)
    below = F.max(mine).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min(mine).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    inside = line.withColumns({"_below": below, "_above": above})
    heads = line.groupBy(*part).agg(F.max(mine).alias("_hi"), F.min(mine).alias("_lo"))
    order = Window.partitionBy(*keys).orderBy("_blk")
    heads = heads.select(
        *part,
        F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_far_below"),
        F.min("_lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_far_above"),
    )
    joined = null_safe_join(inside.where("_w"), heads, part)
    low = F.col(value) - F.coalesce("_below", "_far_below")
    high = F.coalesce("_above", "_far_above") - F.col(value)
    return joined.select(*keys, value, F.least(low, high).alias("gap"))


def with_counterpart(
    persons: DataFrame, person: str, label: str, group: str, value: str, reach: float
) -> DataFrame:
    """Persons who have someone of the other label and the same group within ``reach`` (inclusive)."""
    base = persons.where(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    cells = base.select(F.col(group), F.col(label).alias("_y"), F.col(value).cast("double").alias("_v")).distinct()
    offered = cells.select(group, (1 - F.col("_y")).alias("_y"), "_v")
    near = nearest_values(cells, offered, [group, "_y"], "_v").where(F.col("gap") <= reach)
    marked = base.withColumns({"_y": F.col(label), "_v": F.col(value).cast("double")})
    return marked.join(near, [group, "_y", "_v"], "left_semi").drop("_y", "_v")


def union_cohorts(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def id_differences(left: DataFrame, right: DataFrame, person: str) -> DataFrame:
    """Ids that only one of the two sets holds, with the side that holds them."""
    only_left = left.select(person).distinct().join(right.select(person), person, "left_anti")
    only_right = right.select(person).distinct().join(left.select(person), person, "left_anti")
    return only_left.withColumn("side", F.lit("left")).unionByName(only_right.withColumn("side", F.lit("right")))


def fold_membership_differences(left: DataFrame, right: DataFrame, fold: str, person: str) -> DataFrame:
    """(fold, person) memberships that are in one run only; empty if the folds are the same."""
    a, b = left.select(fold, person).distinct(), right.select(fold, person).distinct()
    return a.join(b, [fold, person], "left_anti").unionByName(b.join(a, [fold, person], "left_anti"))


def gather(samples: DataFrame, ids: str, vectors: DataFrame, vector_id: str, vector: str, sample: str, out: str):
    """Vectors of an ordered id list as one flat array per sample, in the order of the list.

    An id without a vector is an error, raised where the sample is computed; ``missing_ids`` lists them all beforehand. A
    sample with an empty or NULL list has an empty vector. Samples are bounded lists of recordings, so the arrays are
    built inside their own group.
    """
    wide = samples.select(sample, F.posexplode(ids).alias("pos", vector_id))
    known = vectors.select(vector_id, F.struct(F.col(vector).alias("v")).alias("_known"))
    found = wide.join(known, vector_id, "left")
    lost = F.raise_error(F.concat(F.lit(f"no vector for {vector_id} "), F.coalesce(F.col(vector_id).cast("string"), F.lit("NULL"))))
    # The struct is NULL only where the join found nothing.
    present = F.when(F.col("_known").isNull(), lost.cast(known.schema["_known"].dataType)).otherwise(F.col("_known"))
    rows = found.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("pos", present["v"].alias("v")))).alias("_r"))
    flat = F.flatten(F.transform("_r", lambda s: s["v"]))
    gathered = samples.join(rows.select(sample, flat.alias(out)), sample, "left")
    return gathered.withColumn(out, F.coalesce(F.col(out), F.array().cast(vectors.schema[vector].dataType)))


def missing_ids(samples: DataFrame, ids: str, vectors: DataFrame, vector_id: str, sample: str) -> DataFrame:
    """Ids of sample lists that have no vector."""
    wide = samples.select(sample, F.explode(ids).alias(vector_id))
    return wide.join(vectors.select(vector_id), vector_id, "left_anti")


def recording_sets(
    recordings: DataFrame,
    acoustic: Sequence[str],
    embedded: Sequence[str],
    order: Sequence[str],
    person: str = "audio_id",
    category: str = "recording_category",
    identifier: str = "recording_identifier",
) -> DataFrame:
    """Training samples per person: the n-th recording of every category, side by side.

    Inside one feature kind the shortest category decides the number of samples; between the two
    kinds the longer one does, with empty lists for the other. Persons without any get one sample.
    """
    numbered_rows = numbered(recordings, [person, category], list(order), "_n")

    def kind(categories: Sequence[str], name: str) -> DataFrame:
        rows = numbered_rows.where(F.col(category).isin(*categories)) if categories else numbered_rows.limit(0)
        position = F.array_position(F.array(*[F.lit(c) for c in categories] or [F.lit("")]), F.col(category))
        ids = F.transform(
            F.array_sort(F.collect_list(F.struct(position.alias("p"), F.col(identifier).alias("i")))), lambda s: s["i"]
        )
        sets = rows.groupBy(person, "_n").agg(ids.alias(name))
        return sets.where(F.size(name) == len(categories)) if categories else sets

    a, e = kind(acoustic, "acoustic_ids"), kind(embedded, "embed_ids")
    both = a.join(e, [person, "_n"], "full")
    everyone = recordings.select(person).distinct()
    empty = F.array().cast("array<bigint>")
    return everyone.join(both, person, "left").select(
        person,
        F.coalesce("_n", F.lit(1)).cast("long").alias("sample"),
        F.coalesce(F.col("acoustic_ids").cast("array<bigint>"), empty).alias("acoustic_ids"),
        F.coalesce(F.col("embed_ids").cast("array<bigint>"), empty).alias("embed_ids"),
    )


def original_sets(
    recordings: DataFrame, persons: DataFrame, categories: Sequence[str], order: Sequence[str],
    person: str = "audio_id", category: str = "recording_category", missing: str = "error",
) -> DataFrame:
    """First recording per person and category, with its identifier as if it had no chunk.

    A person without one of the categories is an error, raised where its row is computed; with
    ``missing="null"`` its row is kept with NULL as date and identifier.
    """
    if missing not in ("error", "null"):
        raise ValueError(f"unknown treatment {missing} of missing categories")
    wanted = persons.select(person).distinct().withColumn(
        category, F.explode(F.array(*[F.lit(c) for c in categories]))
    )
    first = keep_first(recordings.where(F.col(category).isin(*categories)), [person, category], order)
    rows = wanted.join(first.select(person, category, "date"), [person, category], "left")
    lost = F.lit(None).cast("bigint")
    if missing == "error":
        lost = F.raise_error(F.concat(F.lit("no recording "), F.col(category), F.lit(" of "), F.col(person).cast("string"))).cast("bigint")
    return rows.withColumn(
        "recording_identifier", F.when(F.col("date").isNull(), lost).otherwise(E.recording_identifier(F.col(person), F.col(category), F.col("date")))
    )


def concat_blocks(samples: DataFrame, blocks: Sequence[str], out: str) -> DataFrame:
    """Feature blocks joined in the given order; their sizes are kept beside the vector."""
    sizes = F.array(*[F.size(b) for b in blocks])
    parts = [F.coalesce(F.col(b).cast("array<double>"), F.array().cast("array<double>")) for b in blocks]
    return samples.withColumns({out: F.concat(*parts), f"{out}_sizes": sizes})
