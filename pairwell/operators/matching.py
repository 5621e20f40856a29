"""Propensity-score matching: common support, calipers, greedy 1:k pairs, balance.

Greedy matching lets cases choose in a fixed order; each takes its k nearest controls that no earlier
case holds. The same pairs follow from repeated proposals: a case proposes to its best controls, and a
control keeps the earliest case. The order in which proposals are made does not change the outcome,
so strata are worked on in bounded pieces:

* every stratum is laid out along its score and cut into pieces of at most ``max_rows`` rows;
* inside a piece, a case proposes only where no row outside the piece could be preferred;
* a case that loses a control to an earlier one of its piece proposes again in the same round, in its turn;
* the cuts move by half a piece each round, and pieces cover only rows still in play;
* if a round brings nothing, the pieces double, so the loop always ends with the exact result.

A stratum that fits in one piece is done in one round. Equal scores are spread: every row has a
relative position among the rows of its side with its score, and ties in distance go to the control
with the nearest relative position, then to the lower id.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.scan import cumulate, global_positions, largest_group, measured_join, null_safe_join, numbered
from pairwell.session import durable, replaced, scratch_path

MAX_ROWS = 200_000
#: The holder of a control that no case has: later than every case. Ids and orders are whole numbers throughout.
FREE = (1 << 63) - 1


def with_stratum(df: DataFrame, exact: Sequence[str]) -> DataFrame:
    return df.withColumn("stratum", E.composite_key([F.col(c) for c in exact]) if exact else F.lit("_all_"))


def stratum_facts(df: DataFrame, label: str = "label") -> DataFrame:
    """Per stratum: rows, number of classes, common-support limits. One pass, pre-aggregated."""
    y, ps = F.col(label), F.col("ps")
    return df.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(y == 1).alias("cases"),
        F.count_if(y == 0).alias("controls"),
        F.greatest(F.min(F.when(y == 1, ps)), F.min(F.when(y == 0, ps))).alias("support_low"),
        F.least(F.max(F.when(y == 1, ps)), F.max(F.when(y == 0, ps))).alias("support_high"),
    )


def support_and_caliper(df: DataFrame, caliper: float, label: str = "label") -> DataFrame:
    """Rows inside the common support of their stratum, with ``caliper`` from the local score spread.

    The spread is the sample sd of ``logit_ps`` in the trimmed stratum, else of all rows, else 1.
    """
    facts = stratum_facts(df, label).where("cases > 0 and controls > 0")
    kept = measured_join(df, facts, ["stratum"])
    kept = kept.where((F.col("ps") >= F.col("support_low")) & (F.col("ps") <= F.col("support_high")))
    kept = kept.drop("rows", "cases", "controls", "support_low", "support_high")
    usable = lambda c: (c > 0) & ~F.isnan(c)
    overall = df.agg(F.stddev_samp("logit_ps").alias("s")).select(
        F.when(usable(F.col("s")), F.col("s")).otherwise(1.0)
    )
    local = kept.groupBy("stratum").agg(
        F.stddev_samp("logit_ps").alias("_sd"),
        F.count_if(F.col(label) == 1).alias("_t"),
        F.count_if(F.col(label) == 0).alias("_c"),
    )
    local = local.where("_t > 0 and _c > 0").select(
        "stratum",
        (caliper * F.when(usable(F.col("_sd")), F.col("_sd")).otherwise(overall.scalar())).alias("caliper"),
    )
    return measured_join(kept, local, ["stratum"])


def _relative_positions(df: DataFrame, order: str, id_column: str) -> DataFrame:
    """Add ``u``: position among the rows of one side of a stratum with the same score, in (0, 1)."""
    tie = ["stratum", "is_case", "z"]
    sizes = df.groupBy(*tie).agg(F.count(F.lit(1)).alias("_m"))
    placed = numbered(df, tie, [order, id_column], "_rank")
    joined = null_safe_join(placed, sizes, tie)
    return joined.withColumn("u", (F.col("_rank") - 0.5) / F.col("_m")).drop("_rank", "_m")


def settle_piece(piece: pd.DataFrame, k: int, age_caliper: float | None) -> pd.DataFrame:
    """Proposals inside one bounded piece; returns changed holders and exhausted cases."""
    piece = piece.sort_values(["z", "u", "is_case", "id"], kind="mergesort")
    controls = piece[~piece["is_case"]]
    cases = piece[piece["is_case"]].sort_values("ord", kind="mergesort")
    left_open = bool(piece["left_open"].iloc[0])
    right_open = bool(piece["right_open"].iloc[0])
    first = (float(piece["z"].iloc[0]), float(piece["u"].iloc[0]))
    last = (float(piece["z"].iloc[-1]), float(piece["u"].iloc[-1]))
    caliper = float(piece["caliper"].iloc[0])
    z = controls["z"].tolist()
    u = controls["u"].tolist()
    ids = controls["id"].tolist()
    ages = controls["age"].tolist()
    holder = [FREE if pd.isna(h) else int(h) for h in controls["holder"].tolist()]
    before = list(holder)
    total = len(z)
    exhausted: list[tuple[int, int]] = []
    # Controls held by earlier cases than the present one stay closed to all later ones, so whole
    # runs of them can be skipped: next open position to the right and to the left.
    right_of = list(range(total + 1))
    left_of = list(range(total + 1))

    def find(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    def close(i: int) -> None:
        right_of[i] = i + 1
        left_of[i + 1] = i

    def side(i: int, step: int, low: int, high: int, v: float) -> Iterator[tuple[float, object, int]]:
        while low <= i < high:
            yield abs(u[i] - v), ids[i], i
            i = find(right_of, i + 1) if step > 0 else find(left_of, i) - 1

    def outward(x: float, v: float) -> Iterator[tuple[float, float, int]]:
        """Open controls by distance, then by relative position, then by id."""
        start = bisect.bisect_left(z, x)
        lo, hi = find(left_of, start) - 1, find(right_of, start)
        while True:
            low_gap = x - z[lo] if lo >= 0 else math.inf
            high_gap = z[hi] - x if hi < total else math.inf
            gap = min(low_gap, high_gap)
            if gap > caliper:
                return
            runs = []
            if low_gap == gap:
                runs.append((bisect.bisect_left(z, z[lo]), bisect.bisect_right(z, z[lo])))
                lo = find(left_of, runs[-1][0]) - 1
            if high_gap == gap:
                runs.append((bisect.bisect_left(z, z[hi]), bisect.bisect_right(z, z[hi])))
                hi = find(right_of, runs[-1][1])
            sides = []
            for low, high in runs:
                middle = bisect.bisect_left(u, v, low, high)
                sides.append(side(find(left_of, middle) - 1, -1, low, high, v))
                sides.append(side(find(right_of, middle), 1, low, high, v))
            for du, _, i in heapq.merge(*sides):
                yield gap, du, i

    closing = sorted((h, i) for i, h in enumerate(holder) if h < FREE)
    closed_to = 0
    # Controls that a case lost to earlier ones in this round; it comes after all of them.
    lost: Counter[int] = Counter()
    for order, case_id, x, v, age, need in zip(
        cases["ord"].tolist(), cases["id"].tolist(), cases["z"].tolist(), cases["u"].tolist(),
        cases["age"].tolist(), cases["need"].tolist(),
    ):
        while closed_to < len(closing) and closing[closed_to][0] < order:
            close(closing[closed_to][1])
            closed_to += 1
        need += lost[order]
        if not need:
            continue
        outside = (math.inf, 0.0)
        if left_open:
            outside = min(outside, (x - first[0], max(0.0, v - first[1])))
        if right_open:
            outside = min(outside, (last[0] - x, max(0.0, last[1] - v)))
        taken: list[int] = []
        stuck = False
        for gap, du, i in outward(x, v):
            if holder[i] <= order or (age_caliper is not None and abs(ages[i] - age) > age_caliper):
                continue
            if not (gap, du) < outside:
                stuck = True
                break
            taken.append(i)
            if len(taken) == need:
                break
        for i in taken:
            lost[holder[i]] += 1
            holder[i] = order
            close(i)
        if len(taken) < need and not stuck and outside[0] > caliper:
            exhausted.append((order, case_id))
    rows = [(False, ids[i], h) for i, h in enumerate(holder) if h != before[i]]
    rows += [(True, case_id, int(order)) for order, case_id in exhausted]
    return pd.DataFrame(rows, columns=["is_case", "id", "holder"])


def greedy_match(
    df: DataFrame,
    k: int,
    id_column: str = "person_id",
    order: str | None = None,
    label: str = "label",
    age: str = "age",
    age_caliper: float | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Pairs ``(case_id, control_id, stratum, distance)`` of exact greedy 1:k matching.

    ``df`` needs ``stratum``, ``logit_ps`` and ``caliper``; ids are unique longs and ``order`` is a
    unique whole number that says in which order cases choose (default: the id).
    """
    order = order or id_column
    rows = df.select(
        "stratum",
        (F.col(label) == 1).alias("is_case"),
        F.col(id_column).cast("long").alias("id"),
        F.col(order).cast("long").alias("ord"),
        F.col("logit_ps").cast("double").alias("z"),
        (F.col(age).cast("double") if age in df.columns else F.lit(0.0)).alias("age"),
        F.col("caliper").cast("double").alias("caliper"),
    )
    layout = _relative_positions(rows, "ord", "id")
    if largest_group(rows, ["stratum"]) <= max_rows:
        play = layout.withColumns({"holder": F.lit(FREE).cast("long"), "need": F.lit(k)})
        changes = _settle(_whole_pieces(play), k, age_caliper)
        held = changes.where("not is_case").select("stratum", F.col("id").alias("control_id"), F.col("holder").alias("ord"))
        control_z = rows.where("not is_case").select(F.col("id").alias("control_id"), F.col("z").alias("_zc"))
        return _with_distance(held.join(control_z, "control_id"), rows)
    # The state of a round is a function of the last one, so its estimated size would be a power of the last
    # estimate. Files are read back with their real size; two folders take turns. That size is of packed columns, so
    # joins of the state are hinted: rows of some MB of files would be too many to broadcast.
    folders = [scratch_path(df.sparkSession, "matching") for _ in range(2)]
    state = replaced(layout.withColumns({"holder": F.lit(FREE).cast("long"), "done": F.lit(False)}), folders[0])
    piece_rows, shifted = max_rows, False
    while True:
        placed = _rows_in_play(state, k)
        if placed.isEmpty():
            break
        changes = durable(_settle(_cut(placed, piece_rows, shifted), k, age_caliper))
        if changes.isEmpty():
            # Neither cut brought anything: larger pieces, down to the whole stratum if need be.
            piece_rows = piece_rows * 2 if shifted else piece_rows
        else:
            news = changes.withColumnRenamed("holder", "_new")
            folders.reverse()
            state = replaced(
                state.join(news, ["stratum", "is_case", "id"], "left").withColumns(
                    {
                        "holder": F.when(F.col("is_case"), F.col("holder")).otherwise(F.least("holder", "_new")),
                        "done": F.col("done") | (F.col("is_case") & F.col("_new").isNotNull()),
                    }
                ).drop("_new"),
                folders[0],
            )
        shifted = not shifted
    taken = state.where(f"not is_case and holder < {FREE}").select(
        "stratum", F.col("holder").alias("ord"), F.col("id").alias("control_id"), F.col("z").alias("_zc")
    )
    return _with_distance(taken, state)


def _rows_in_play(state: DataFrame, k: int) -> DataFrame:
    """Cases that want controls, later ones that may lose some, and controls they could get, with their position in the stratum."""
    held = state.where(f"not is_case and holder < {FREE}").groupBy("stratum", F.col("holder").alias("ord")).agg(
        F.count(F.lit(1)).alias("held")
    )
    cases = (
        state.where("is_case and not done")
        .join(held.hint("merge"), ["stratum", "ord"], "left")
        .withColumn("need", (F.lit(k) - F.coalesce("held", F.lit(0))).cast("int"))
        .drop("held", "done")
    )
    controls = state.where("not is_case").drop("done").withColumn("need", F.lit(0))
    earliest = cases.where("need > 0").groupBy("stratum").agg(F.min("ord").alias("_first"))
    concerned = F.when(F.col("is_case"), F.col("ord") >= F.col("_first")).otherwise(F.col("holder") > F.col("_first"))
    play = measured_join(cases.unionByName(controls), earliest, ["stratum"]).where(concerned).drop("_first")
    return global_positions(play, ["stratum"], ["z", "u", "is_case", "id"], "pos")


def _with_distance(taken: DataFrame, cases: DataFrame) -> DataFrame:
    chosen = cases.where("is_case").select("stratum", "ord", F.col("id").alias("case_id"), F.col("z").alias("_zt"))
    return taken.join(chosen.hint("merge"), ["stratum", "ord"]).select(
        "case_id", "control_id", "stratum", F.abs(F.col("_zc") - F.col("_zt")).alias("distance")
    )


def _whole_pieces(play: DataFrame) -> DataFrame:
    return play.withColumns({"piece": F.lit(0), "left_open": F.lit(False), "right_open": F.lit(False)})


def _settle(pieces: DataFrame, k: int, age_caliper: float | None) -> DataFrame:
    def settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        changed = settle_piece(frame, k, age_caliper)
        changed.insert(0, "stratum", key[0])
        return changed

    schema = "stratum string, is_case boolean, id long, holder long"
    return pieces.groupBy("stratum", "piece").applyInPandas(settle, schema)


def _cut(placed: DataFrame, piece_rows: int, shifted: bool) -> DataFrame:
    """Pieces of consecutive positions; a stratum that fits stays whole."""
    sizes = placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_size"))
    sized = measured_join(placed, sizes, ["stratum"])
    offset = piece_rows // 2 if shifted else 0
    number = lambda p: F.floor((p + offset) / piece_rows)
    whole = F.col("_size") <= piece_rows
    return sized.withColumns(
        {
            "piece": F.when(whole, 0).otherwise(number(F.col("pos"))).cast("int"),
            "left_open": ~whole & (number(F.col("pos")) > 0),
            "right_open": ~whole & (number(F.col("pos")) < number(F.col("_size") - 1)),
        }
    ).drop("pos", "_size")


def drop_reasons(
    df: DataFrame, kept: DataFrame, pairs: DataFrame, label: str = "label", id_column: str = "person_id",
    age: str = "age", age_caliper: float | None = None,
) -> DataFrame:
    """Why rows or cases are lost. The first three reasons count rows, the last two count cases."""
    facts = stratum_facts(df, label)
    single = facts.where("cases = 0 or controls = 0").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    two = facts.where("cases > 0 and controls > 0")
    inside = null_safe_join(df, two, ["stratum"]).where(
        (F.col("ps") >= F.col("support_low")) & (F.col("ps") <= F.col("support_high"))
    )
    left = inside.groupBy("stratum").agg(
        F.count_if(F.col(label) == 1).alias("t"), F.count_if(F.col(label) == 0).alias("c")
    )
    no_support = left.where("t = 0 or c = 0").agg(F.coalesce(F.sum(F.col("t") + F.col("c")), F.lit(0)).alias("n"))
    cases = kept.where(F.col(label) == 1).select(F.col(id_column).alias("case_id"), "stratum", F.col(age).alias("_a"))
    unmatched = cases.join(pairs.select("case_id").distinct(), "case_id", "left_anti")
    if age_caliper is None:
        no_age = unmatched.limit(0).select("case_id")
    else:
        no_age = _without_neighbour(unmatched, kept.where(F.col(label) == 0), age, age_caliper)
    total_unmatched = unmatched.agg(F.count(F.lit(1)).alias("n"))
    counts = [
        single.select(F.lit("no_opposite_label").alias("reason"), F.col("n").cast("long")),
        no_support.select(F.lit("no_support").alias("reason"), F.col("n").cast("long")),
        # Strata that lack a side after the trim are counted above, so nothing can be left here.
        single.select(F.lit("empty_after_filter").alias("reason"), F.lit(0).cast("long").alias("n")),
        no_age.agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_ctrl_within_age_caliper").alias("reason"), "n"),
        total_unmatched.select(
            F.lit("no_match_within_ps_caliper").alias("reason"),
            (F.col("n") - no_age.agg(F.count(F.lit(1))).scalar()).alias("n"),
        ),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _without_neighbour(cases: DataFrame, controls: DataFrame, age: str, reach: float) -> DataFrame:
    """Cases whose stratum has no control within ``reach`` of their age (works on distinct ages)."""
    from pairwell.operators.joins import nearest_values

    wanted = cases.select("stratum", F.col("_a").cast("double").alias("v")).distinct()
    offered = controls.select("stratum", F.col(age).cast("double").alias("v")).distinct()
    near = nearest_values(wanted, offered, ["stratum"], "v")
    far = near.where(~F.coalesce(F.col("gap") <= reach, F.lit(False))).select("stratum", "v")
    return cases.withColumn("v", F.col("_a").cast("double")).join(far, ["stratum", "v"], "left_semi").select("case_id")


def matched_long(df: DataFrame, pairs: DataFrame, id_column: str = "person_id") -> DataFrame:
    """Members of each pair as rows, with ``pair_id`` and the number of controls of the pair."""
    ratio = pairs.groupBy("case_id", "stratum").agg(F.count(F.lit(1)).alias("match_ratio_k"))
    pair_id = F.concat_ws("|", "stratum", F.col("case_id").cast("string"))
    cases = ratio.select(F.col("case_id").alias(id_column), pair_id.alias("pair_id"), "match_ratio_k")
    controls = pairs.join(ratio.select("case_id", "match_ratio_k"), "case_id").select(
        F.col("control_id").alias(id_column), pair_id.alias("pair_id"), "match_ratio_k"
    )
    # Files of persons may be small for their rows, which must not make them a table for the driver to broadcast.
    return df.hint("merge").join(cases.unionByName(controls), id_column)


def balance(
    before: DataFrame, after: DataFrame, binary: Sequence[str], continuous: Sequence[str], label: str = "label"
) -> DataFrame:
    """Standardized mean differences before and after, largest remaining imbalance first."""

    def phase(df: DataFrame, name: str) -> DataFrame:
        case, control = F.col(label) == 1, F.col(label) == 0
        aggregates, names = [], []
        for c in [b for b in binary if b in df.columns]:
            one = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).cast("int") == 1).cast("double")
            p1, p0 = F.avg(F.when(case, one)), F.avg(F.when(control, one))
            p = (p1 + p0) / 2
            aggregates.append(((p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)))).alias(c))
            names.append(c)
        for c in [x for x in continuous if x in df.columns]:
            x = F.col(c).cast("double")
            a, b = F.when(case, x), F.when(control, x)
            spread = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2 + 1e-12)
            aggregates.append(((F.avg(a) - F.avg(b)) / spread).alias(c))
            names.append(c)
        return df.agg(*aggregates).unpivot([], names, "covariate", name)

    table = phase(before, "smd_before").join(phase(after, "smd_after"), "covariate", "full")
    return table.orderBy(F.abs("smd_after").desc_nulls_last(), "covariate")


class MatchingQualityError(RuntimeError):
    """A matched cohort failed its quality gates."""


def quality(
    before: DataFrame, matched: DataFrame, smd: DataFrame, label: str = "label",
    smd_limit: float = 0.20, min_retention: float = 80.0, min_ratio: float = 2.0,
) -> DataFrame:
    """One row of retention, ratio, worst imbalance and whether every gate is passed."""
    pre = before.agg(F.count_if(F.col(label) == 1).alias("n")).scalar()
    post = matched.agg(
        F.count_if(F.col(label) == 1).alias("n_cases"), F.count_if(F.col(label) == 0).alias("n_controls")
    )
    worst = smd.agg(F.coalesce(F.max(F.abs("smd_after")), F.lit(0.0)).alias("m")).scalar()
    row = post.select(
        pre.alias("n_cases_before"),
        "n_cases",
        "n_controls",
        (100.0 * F.col("n_cases") / F.greatest(pre, F.lit(1))).alias("case_retention_pct"),
        (F.col("n_controls") / F.greatest(F.col("n_cases"), F.lit(1))).alias("effective_ratio"),
        worst.alias("max_abs_smd"),
    )
    return row.withColumn(
        "quality_passed",
        (F.col("max_abs_smd") <= smd_limit)
        & (F.col("case_retention_pct") >= min_retention)
        & (F.col("effective_ratio") >= min_ratio),
    )


def require_quality(row: DataFrame) -> None:
    found = row.first()
    if not found["quality_passed"]:
        raise MatchingQualityError(f"matching quality gates failed: {found.asDict()}")


def nearest_candidates(df: DataFrame, k: int, id_column: str = "person_id", label: str = "label") -> DataFrame:
    """The k nearest controls of every case within the caliper, along the score of its stratum.

    Controls get a position in the stratum for either side: by score and id for the cases below them,
    by score and falling id for the cases above, so that of equal scores the lower ids are the nearer
    ones both times. A case looks at the k positions on either side of its own, so 2k rows per case
    meet the controls in an equality join; no pairs are enumerated.
    """
    base = df.select(
        "stratum",
        (F.col(label) == 1).cast("int").alias("side"),
        F.col(id_column).alias("id"),
        F.col("logit_ps").alias("z"),
        "caliper",
    )
    controls = numbered(base.where("side = 0"), ["stratum"], ["z", "id"], "pos")
    per_value = base.groupBy("stratum", "z").agg(F.sum(1 - F.col("side")).alias("c"))
    before = cumulate(per_value, ["stratum"], "z", ["c"]).select("stratum", "z", "c", F.col("c_before").alias("_b"))
    cases = base.where("side = 1").join(before, ["stratum", "z"])
    # Ties at the case's own score count as the right-hand side, so k of them may be needed there.
    pos = F.explode(F.sequence(F.col("_b") + 1 - k, F.col("_b") + k))
    reach = cases.withColumn("pos", pos).withColumn("below", F.col("pos") <= F.col("_b"))
    # Among c equal scores after _b others, the position by falling id mirrors the one by id.
    mirrored = 2 * F.col("_b") + F.col("c") + 1 - F.col("pos")
    sides = F.array(
        F.struct(F.lit(False).alias("below"), F.col("pos").alias("pos")), F.struct(F.lit(True).alias("below"), mirrored.alias("pos"))
    )
    offered = controls.join(before, ["stratum", "z"]).select(
        "stratum", F.col("id").alias("control_id"), F.col("z").alias("_zc"), F.inline(sides)
    )
    near = reach.join(offered, ["stratum", "below", "pos"]).withColumn("distance", F.abs(F.col("_zc") - F.col("z")))
    near = near.where("distance <= caliper")
    ranked = Window.partitionBy("id").orderBy("distance", "control_id")
    return (
        near.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias("case_id"), "control_id", "distance", "rank")
    )


def candidate_counts(df: DataFrame, id_column: str = "person_id", label: str = "label") -> DataFrame:
    """Number of controls within the caliper of every case, from two running counts per case."""
    cases = df.where(F.col(label) == 1).select(
        F.col(id_column).alias("case_id"), "stratum", F.col("logit_ps").alias("z"), "caliper"
    )
    ends = cases.select(
        "stratum",
        F.explode(F.array(F.col("z") - F.col("caliper"), F.col("z") + F.col("caliper"))).alias("z"),
    ).distinct().withColumn("c", F.lit(0))
    points = df.where(F.col(label) == 0).select("stratum", F.col("logit_ps").alias("z"), F.lit(1).alias("c"))
    merged = ends.unionByName(points).groupBy("stratum", "z").agg(F.sum("c").alias("c"))
    running = cumulate(merged, ["stratum"], "z", ["c"]).select("stratum", "z", "c", "c_before")
    low = running.select("stratum", F.col("z").alias("_lo"), F.col("c_before").alias("_nlo"))
    high = running.select("stratum", F.col("z").alias("_hi"), (F.col("c_before") + F.col("c")).alias("_nhi"))
    probed = cases.withColumns({"_lo": F.col("z") - F.col("caliper"), "_hi": F.col("z") + F.col("caliper")})
    return (
        probed.join(low, ["stratum", "_lo"])
        .join(high, ["stratum", "_hi"])
        .select("case_id", "stratum", (F.col("_nhi") - F.col("_nlo")).alias("n_candidates"))
    )


def age_pairs(
    df: DataFrame, group: str, age: str, label: str, id_column: str, reach: float = 5, max_ages: int = 100_000
) -> DataFrame:
    """Nearest-age 1:1 pairs inside a group; cases choose by rising age, ties go to the lower age.

    All cases of one age choose in a row, so the choice depends only on how many cases and controls
    there are per age. The plan is made on those counts; persons are then attached by their rank
    among the persons of the same group, age and label.
    """
    y = F.col(label)
    people = df.where(F.col(age).isNotNull()).select(
        F.col(group).alias("g"), F.col(age).cast("double").alias("a"), y.alias("y"), F.col(id_column).alias("id")
    )
    counts = people.groupBy("g", "a").agg(F.count_if(F.col("y") == 1).alias("cases"), F.count_if(F.col("y") == 0).alias("controls"))
    if largest_group(counts, ["g"]) > max_ages:
        raise ValueError("ages are too finely divided; round them, or use greedy_match")

    def plan(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("a")
        ages = frame["a"].tolist()
        left = dict(zip(ages, frame["controls"].tolist()))
        begun = {a: 0 for a in ages}
        rows = []
        for a, n in zip(ages, frame["cases"].tolist()):
            near = [b for b in ages[bisect.bisect_left(ages, a - reach) : bisect.bisect_right(ages, a + reach)] if left[b] > 0]
            near.sort(key=lambda b: (abs(b - a), b))
            done = 0
            for b in near:
                m = min(n - done, left[b])
                if m == 0:
                    break
                rows.append((key[0], a, b, done, begun[b], m))
                done, begun[b], left[b] = done + m, begun[b] + m, left[b] - m
        return pd.DataFrame(rows, columns=["g", "a", "b", "case_from", "control_from", "m"])

    kind = df.schema[group].dataType.simpleString()
    segments = counts.groupBy("g").applyInPandas(
        plan, f"g {kind}, a double, b double, case_from long, control_from long, m long"
    )
    ranked = numbered(people, ["g", "a", "y"], ["id"], "_r").withColumn("_r", F.col("_r") - 1)
    cases = ranked.where("y = 1").select("g", "a", F.col("_r").alias("_rc"), F.col("id").alias("case_id"))
    controls = ranked.where("y = 0").select("g", F.col("a").alias("b"), F.col("_r").alias("_rk"), F.col("id").alias("control_id"))
    placed = cases.join(segments, ["g", "a"]).where(
        (F.col("_rc") >= F.col("case_from")) & (F.col("_rc") < F.col("case_from") + F.col("m"))
    )
    placed = placed.withColumn("_rk", F.col("control_from") + F.col("_rc") - F.col("case_from"))
    return placed.join(controls, ["g", "b", "_rk"]).select(
        F.col("g").alias(group), "case_id", "control_id", F.col("a").alias("case_age"), F.col("b").alias("control_age")
    )
