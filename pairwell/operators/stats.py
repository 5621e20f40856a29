"""Hypothesis tests and a random-intercept model, from aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import special
from pairwell.operators.ranking import spearman
from pairwell.operators.scan import block_of, cumulate, null_safe_join, value_bounds
from pairwell.session import durable


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence test of two columns; Yates' correction for a 2x2 table."""
    base = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = base.groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("r").agg(F.sum("n").alias("nr"))
    columns = cells.groupBy("c").agg(F.sum("n").alias("nc"))
    # Empty cells need no rows of their own: their share follows from the margins.
    filled = cells.join(rows, "r").join(columns, "c")
    row_facts = rows.agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("nr")).alias("inv"), F.sum("nr").alias("total"))
    column_facts = columns.agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("nc")).alias("inv"))
    total = row_facts.select("total").scalar()
    gap = F.abs(F.col("n") - F.col("nr") * F.col("nc") / total)
    result = filled.agg(
        F.sum(F.col("n") * F.col("n") / (F.col("nr") * F.col("nc"))).alias("_s"), F.max(gap).alias("_gap")
    ).withColumns(
        {
            "_total": total,
            "dof": ((row_facts.select("k").scalar() - 1) * (column_facts.select("k").scalar() - 1)).cast("int"),
            "_inverse": row_facts.select("inv").scalar() * column_facts.select("inv").scalar(),
        }
    )
    # In a 2x2 table every cell is off by the same amount, which the correction shortens.
    short = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    statistic = F.when(F.col("dof") == 1, short * short * F.col("_total") * F.col("_inverse")).otherwise(
        F.col("_total") * (F.col("_s") - 1)
    )
    result = result.select(statistic.alias("statistic"), "dof")
    return result.withColumn("p_value", special.chi_square_p_value("statistic", F.col("dof").cast("double")))


def two_by_two(df: DataFrame, first: Column, second: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of a 2x2 table: first yes/no by second yes/no."""
    count = lambda x, y: F.count_if((first == x) & (second == y))
    return df.groupBy(*keys).agg(
        count(True, True).alias("a"), count(True, False).alias("b"),
        count(False, True).alias("c"), count(False, False).alias("d"),
    )


def fisher(cells: DataFrame) -> DataFrame:
    """Two-sided exact p and the sample odds ratio of ``a, b, c, d``; no ratio if a margin is empty."""
    a, b, c, d = (F.col(x) for x in "abcd")
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    odds = F.when((margins > 0) & (b * c > 0), a * d / (b * c)).when(margins > 0, float("inf"))
    return cells.withColumn("odds_ratio", odds).withColumn("p_value", special.fisher_p_value("a", "b", "c", "d"))


def welch(df: DataFrame, label: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t test of label 1 against label 0, one row per column."""
    long = df.select(*keys, F.col(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*keys, "_y"], list(columns), "variable", "x"
    )
    side = lambda y: F.when(F.col("_y") == y, F.col("x"))
    stats = long.where("x is not null").groupBy(*keys, "variable").agg(
        F.avg(side(1)).alias("mean_case"), F.stddev_samp(side(1)).alias("sd_case"), F.count(side(1)).alias("n_case"),
        F.avg(side(0)).alias("mean_control"), F.stddev_samp(side(0)).alias("sd_control"),
        F.count(side(0)).alias("n_control"),
    )
    a = F.pow("sd_case", F.lit(2)) / F.col("n_case")
    b = F.pow("sd_control", F.lit(2)) / F.col("n_control")
    usable = (F.col("n_case") > 1) & (F.col("n_control") > 1) & (a + b > 0)
    stats = stats.withColumns(
        {
            "t": F.when(usable, (F.col("mean_case") - F.col("mean_control")) / F.sqrt(a + b)),
            "df": F.when(usable, F.pow(a + b, F.lit(2)) / (a * a / (F.col("n_case") - 1) + b * b / (F.col("n_control") - 1))),
        }
    )
    return stats.withColumn("p_value", special.t_p_value("t", "df"))


def benjamini_hochberg(df: DataFrame, p: str, out: str, bounds: Sequence[float] | None = None) -> DataFrame:
    """Adjusted p-values: running minimum from the largest p down of ``p * m / rank``.

    ``bounds=[]`` says that the table is short and needs no blocks.
    """
    if bounds is None:
        bounds = value_bounds(df, p)
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    # Equal p-values share the rank of the last of them. Distinct p-values go through the ordered scan.
    ranked = cumulate(counts, [], p, ["_n"], bounds)
    scaled = ranked.withColumn("_q", F.col(p) * F.col("_n_total") / (F.col("_n_before") + F.col("_n")))
    if not bounds:
        down = Window.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
        short = scaled.select(p, F.least(F.min("_q").over(down), F.lit(1.0)).alias(out))
        return df.join(short, p, "left")
    marked = scaled.withColumn("_blk", block_of(F.col(p), bounds))
    down = Window.partitionBy("_blk").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_inner", F.min("_q").over(down))
    heads = marked.groupBy("_blk").agg(F.min("_q").alias("_m"))
    # At most one row per block.
    later = Window.orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_blk", F.min("_m").over(later).alias("_after"))
    joined = null_safe_join(marked, heads, ["_blk"])
    adjusted = joined.select(p, F.least(F.col("_inner"), F.col("_after"), F.lit(1.0)).alias(out))
    return df.join(adjusted, p, "left")


def _design(df: DataFrame, factors: Mapping[str, tuple[str, Sequence[str]]]) -> tuple[list[str], list[Column]]:
    """Term names and 0/1 columns of treatment coding: intercept, then every level but the reference."""
    names, columns = ["Intercept"], [F.lit(1.0)]
    for short, (column, levels) in factors.items():
        for level in levels:
            names.append(f"{short}: {level}")
            columns.append((F.col(column) == level).cast("double"))
    return names, columns


def factor_levels(df: DataFrame, columns: Mapping[str, tuple[str, str]], limit: int = 100) -> dict[str, tuple[str, list[str]]]:
    """Sorted levels without the reference, per factor ``short -> (column, reference)``."""
    out = {}
    for short, (column, reference) in columns.items():
        seen = [r[0] for r in df.select(column).distinct().orderBy(column).limit(limit + 1).collect()]
        if len(seen) > limit:
            raise ValueError(f"{column} has more than {limit} levels")
        out[short] = (column, [s for s in seen if s is not None and s != reference])
    return out


def random_intercept(
    df: DataFrame, response: str, group: str, factors: Mapping[str, tuple[str, Sequence[str]]]
) -> tuple[DataFrame, dict[str, float]]:
    """REML fit of ``response ~ factors + (1 | group)``: coefficient table and variance components.

    Rows are added up once to per-group sums, and those to sums over groups of equal size. For a given
    variance ratio the whole likelihood follows from these, so only p x p matrices reach the driver,
    one per distinct group size.
    """
    names, columns = _design(df, factors)
    p = len(names)
    values = [*columns, F.col(response).cast("double")]
    base = df.where(F.col(response).isNotNull()).select(F.col(group).alias("_g"), *[v.alias(f"x{i}") for i, v in enumerate(values)])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    within = base.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    sums = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p + 1)])
    by_size = sums.groupBy("_n").agg(
        F.count(F.lit(1)).alias("_m"),
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i, j in pairs],
    ).collect()

    def square(row) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"c{i}_{j}"]
        return m

    n = within["n"]
    total = square(within)
    parts = [(float(r["_n"]), float(r["_m"]), square(r)) for r in by_size]

    def solve(ratio: float):
        """Cross-products under V = I + ratio * 11' per group, with the REML criterion."""
        m, log_v = total.copy(), 0.0
        for size, groups, s in parts:
            m -= ratio / (1 + ratio * size) * s
            log_v += groups * math.log1p(ratio * size)
        xx, xy, yy = m[:p, :p], m[:p, p], m[p, p]
        beta = np.linalg.solve(xx, xy)
        rss = max(yy - xy @ beta, 1e-300)
        sign, log_xx = np.linalg.slogdet(xx)
        scale = rss / (n - p)
        value = (n - p) * math.log(scale) + log_v + log_xx
        return value, beta, xx, scale, log_v, log_xx

    # One-dimensional search over log(1 + ratio): a grid for the basin, then golden section.
    spread = np.concatenate([[0.0], np.exp(np.linspace(-12, 12, 97))])
    scores = [solve(r)[0] for r in spread]
    at = int(np.argmin(scores))
    low, high = spread[max(at - 1, 0)], spread[min(at + 1, len(spread) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    a, b = low, high
    x1, x2 = b - golden * (b - a), a + golden * (b - a)
    f1, f2 = solve(x1)[0], solve(x2)[0]
    for _ in range(200):
        if f1 < f2:
            b, x2, f2 = x2, x1, f1
            x1 = b - golden * (b - a)
            f1 = solve(x1)[0]
        else:
            a, x1, f1 = x1, x2, f2
            x2 = a + golden * (b - a)
            f2 = solve(x2)[0]
        if b - a <= 1e-12 * (1 + b):
            break
    ratio = min([(solve(r)[0], r) for r in (0.0, (a + b) / 2)])[1]
    value, beta, xx, scale, log_v, log_xx = solve(ratio)
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * scale)
    log_likelihood = -0.5 * ((n - p) * (math.log(2 * math.pi * scale) + 1) + log_v + log_xx)
    facts = {
        "group_var": ratio * scale,
        "residual_var": scale,
        "icc": ratio / (1 + ratio),
        "n_obs": n,
        "n_groups": int(sum(m for _, m, _ in parts)),
        "log_likelihood": log_likelihood,
    }
    rows = [(t, float(b_), float(s_)) for t, b_, s_ in zip(names, beta, se)]
    table = df.sparkSession.createDataFrame(rows, "term string, estimate double, se double")
    return wald(table), facts


def wald(table: DataFrame, estimate: str = "estimate", se: str = "se") -> DataFrame:
    z = F.col(estimate) / F.col(se)
    reach = 1.959963984540054 * F.col(se)
    with_z = table.withColumns({"z": z, "ci_lower": F.col(estimate) - reach, "ci_upper": F.col(estimate) + reach})
    return with_z.withColumn("p_value", special.normal_p_value("z"))


def compare_fits(raw: DataFrame, transformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coefficients of two fits side by side with adjusted p-values, and their rank correlation."""
    pick = lambda t, s: t.where("term <> 'Intercept'").select(
        "term", F.col("estimate").alias(f"estimate_{s}"), F.col("p_value").alias(f"p_{s}")
    )
    both = pick(raw, "raw").join(pick(transformed, "logit"), "term")
    # One row per coefficient, a few dozen at most: stored once and ranked without blocks.
    both = durable(both)
    both = benjamini_hochberg(benjamini_hochberg(both, "p_raw", "p_raw_bh", []), "p_logit", "p_logit_bh", [])
    both = both.withColumn("sign_match", F.signum("estimate_raw") == F.signum("estimate_logit"))
    return both, spearman(both, "estimate_raw", "estimate_logit", [])
