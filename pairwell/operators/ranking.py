"""Orders, ranks and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.operators.scan import cumulate, global_positions, null_safe_join, numbered


def temporal_order(df: DataFrame, person: str, date: str, tie: Sequence[str], out: str = "temporal_order") -> DataFrame:
    """1, 2, 3, ... by date within each person."""
    return numbered(df, [person], [date, *tie], out)


def first_seen_ids(df: DataFrame, key: str, order: Sequence[str], start: int, out: str) -> DataFrame:
    """Dense ids in the order in which keys first appear.

    Each key's first place is an aggregate; the keys are then range-ordered and counted per
    partition, so no task sees them all.
    """
    place = F.min(F.struct(*order)).alias("_first")
    firsts = df.groupBy(key).agg(place)
    flat = firsts.select(key, *[F.col(f"_first.{o}").alias(f"_o{i}") for i, o in enumerate(order)])
    ranked = global_positions(flat, [], [*[f"_o{i}" for i in range(len(order))], key], "_pos")
    ids = ranked.select(key, (F.col("_pos") + start).alias(out))
    return null_safe_join(df, ids, [key])


def stable_sort(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def sort_positions(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """The place of every row in an order without ties, from 0; a name stands for ascending with NULLs last.

    Rows are range-partitioned and counted per partition, so the order of a table of any size is data that can be stored.
    """
    return global_positions(df, [], order, out)


def top_n(df: DataFrame, column: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *tie).limit(n)


def by_size(df: DataFrame, column: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.abs(column).desc_nulls_last(), *tie)


def best_per_group(df: DataFrame, group: str, column: str, tie: Sequence[str], n: int | None = 1) -> DataFrame:
    """Best rows per group, all of them if ``n`` is None; a missing figure counts as -1.

    A limit is applied before rows are shuffled; without one, groups of any size are numbered in parts.
    """
    order = [F.coalesce(column, F.lit(-1)).desc(), *tie]
    if n is None:
        return numbered(df, [group], order, "rank")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def average_ranks(
    df: DataFrame, column: str, out: str, keys: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Ranks with ties at their mean, from counts per value."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulate(counts, list(keys), column, ["_n"], bounds)
    ranks = ranked.select(*keys, column, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out))
    return null_safe_join(df, ranks, [*keys, column])


def spearman(df: DataFrame, a: str, b: str, bounds: Sequence[float] | None = None) -> DataFrame:
    ranked = average_ranks(average_ranks(df, a, "_ra", bounds=bounds), b, "_rb", bounds=bounds)
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def sibling_count(df: DataFrame, person: str, out: str) -> DataFrame:
    counts = df.groupBy(person).agg(F.count(F.lit(1)).alias(out))
    return null_safe_join(df, counts, [person])
