import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwell.operators import matching
from pairwell.plans import matched_cohort
from pairwell.plans.matched_cohort import MatchSpec


def people(n, seed, digits=None, case_share=0.3, strata=("s",)):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    if digits is not None:
        z = z.round(digits)
    return pd.DataFrame(
        {
            "person_id": rng.permutation(n),
            "stratum": rng.choice(list(strata), n),
            "label": (rng.random(n) < case_share).astype(int),
            "logit_ps": z,
            "age": rng.integers(20, 80, n).astype(float),
            "caliper": 0.4,
        }
    )


def sequential(df, k, age_caliper=None):
    """Plain greedy loop: cases in id order, nearest first, then relative position, then id."""
    pairs = set()
    for _, s in df.groupby("stratum"):
        s = s.copy()
        tie = s.groupby(["label", "logit_ps"])["person_id"]
        s["u"] = (tie.rank(method="first") - 0.5) / tie.transform("count")
        controls = s[s.label == 0]
        used = set()
        for _, c in s[s.label == 1].sort_values("person_id").iterrows():
            d = (controls.logit_ps - c.logit_ps).abs()
            near = controls.assign(d=d, du=(controls.u - c.u).abs())
            near = near[near.d <= c.caliper]
            if age_caliper is not None:
                near = near[(near.age - c.age).abs() <= age_caliper]
            near = near[~near.person_id.isin(used)].sort_values(["d", "du", "person_id"]).head(k)
            used |= set(near.person_id)
            pairs |= {(int(c.person_id), int(p)) for p in near.person_id}
    return pairs


def run(spark, df, k, age_caliper=None, max_rows=matching.MAX_ROWS):
    out = matching.greedy_match(spark.createDataFrame(df), k, age_caliper=age_caliper, max_rows=max_rows)
    return {(r.case_id, r.control_id) for r in out.collect()}


@pytest.mark.parametrize("seed,digits,age", [(2, 1, None), (3, 0, 6)])
def test_one_piece_equals_sequential_greedy(spark, seed, digits, age):
    df = people(160, seed, digits, strata=("a", "b"))
    assert run(spark, df, 2, age) == sequential(df, 2, age)


@pytest.mark.parametrize("seed,digits,age,rows", [(5, None, None, 60), (7, 1, 8, 60)])
def test_small_pieces_give_the_same_pairs(spark, seed, digits, age, rows):
    df = people(120, seed, digits, case_share=0.3)
    assert run(spark, df, 1, age, max_rows=rows) == sequential(df, 1, age)


def test_one_score_for_all_rows_is_cut_into_pieces(spark):
    df = people(100, 8, case_share=0.25)
    df["logit_ps"] = 0.0
    assert run(spark, df, 2, None, max_rows=60) == sequential(df, 2)


def test_more_cases_than_controls(spark):
    df = people(90, 9, case_share=0.6)
    assert run(spark, df, 2, None, max_rows=50) == sequential(df, 2)


def test_pieces_agree_with_the_sequential_loop_on_random_inputs():
    """Without Spark: a whole stratum as one piece, many times."""
    for seed in range(60):
        df = people(60, 100 + seed, digits=[None, 1, 0][seed % 3], case_share=[0.2, 0.5][seed % 2])
        tie = df.groupby(["label", "logit_ps"])["person_id"]
        frame = pd.DataFrame(
            {
                "stratum": df.stratum, "is_case": df.label == 1, "id": df.person_id, "ord": df.person_id.astype(float),
                "z": df.logit_ps, "age": df.age, "caliper": df.caliper, "holder": np.nan, "need": 2,
                "u": (tie.rank(method="first") - 0.5) / tie.transform("count"), "left_open": False, "right_open": False,
            }
        )
        age = None if seed % 4 else 7
        out = matching.settle_piece(frame, 2, age)
        got = {(int(r.holder), int(r.id)) for r in out[~out.is_case.astype(bool)].itertuples()}
        assert got == sequential(df, 2, age)


def test_no_control_is_used_twice_and_distances_stay_inside(spark):
    df = people(300, 11, strata=("a", "b", "c"))
    out = matching.greedy_match(spark.createDataFrame(df), 3).toPandas()
    assert not out.control_id.duplicated().any()
    assert (out.distance <= 0.4).all()
    assert out.groupby("case_id").size().max() <= 3


def test_age_pairs_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    df = pd.DataFrame(
        {"id": range(200), "g": rng.choice(["F", "M"], 200), "label": rng.integers(0, 2, 200), "age": rng.integers(30, 60, 200)}
    )
    expected = set()
    for _, s in df.groupby("g"):
        used = set()
        for _, c in s[s.label == 1].sort_values(["age", "id"]).iterrows():
            near = s[(s.label == 0) & ~s.id.isin(used) & ((s.age - c.age).abs() <= 5)]
            if len(near):
                best = near.assign(d=(near.age - c.age).abs()).sort_values(["d", "age", "id"]).iloc[0]
                used.add(best.id)
                expected.add((c.id, best.id))
    got = matching.age_pairs(spark.createDataFrame(df), "g", "age", "label", "id", 5).collect()
    assert {(r.case_id, r.control_id) for r in got} == expected


def test_drop_reasons_and_support(spark):
    rows = [
        (1, 1, 0.5, 40.0, "a"), (2, 0, 0.5, 41.0, "a"), (3, 0, 0.9, 42.0, "a"),  # 3 is outside the support
        (4, 1, 0.4, 40.0, "b"), (5, 1, 0.6, 40.0, "b"),  # no control at all
        (6, 1, 0.2, 40.0, "c"), (7, 0, 0.8, 40.0, "c"),  # ranges do not meet
        (8, 1, 0.5, 20.0, "d"), (9, 0, 0.5, 70.0, "d"),  # nobody of that age
    ]
    df = spark.createDataFrame(rows, "person_id long, label int, ps double, age double, site string")
    df = df.withColumn("logit_ps", F.ln(F.col("ps") / (1 - F.col("ps"))))
    people = matching.with_stratum(df, ["site"])
    kept = matching.support_and_caliper(people, 0.2)
    pairs = matching.greedy_match(kept, 1, age_caliper=5)
    assert [(r.case_id, r.control_id) for r in pairs.collect()] == [(1, 2)]
    reasons = {r.reason: r.n for r in matching.drop_reasons(people, kept, pairs, age_caliper=5).collect()}
    assert reasons == {
        "no_opposite_label": 2, "no_support": 0, "empty_after_filter": 0,
        "no_ctrl_within_age_caliper": 1, "no_match_within_ps_caliper": 0,
    }


def test_null_is_a_stratum_of_its_own(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, site string")
    assert {r.stratum for r in matching.with_stratum(df, ["site"]).collect()} == {"nan", "x"}


def test_quality_gate_raises(spark):
    before = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "person_id int, label int")
    smd = spark.createDataFrame([("age", 0.1, 0.5)], "covariate string, smd_before double, smd_after double")
    with pytest.raises(matching.MatchingQualityError):
        matching.require_quality(matching.quality(before, before, smd))


def test_swapped_matching_restores_labels(spark):
    df = people(120, 21, case_share=0.8).drop(columns=["stratum", "logit_ps", "caliper"])
    df["flag"] = (df.age > 50).astype(int)
    found = matched_cohort.match_swapped(spark.createDataFrame(df), MatchSpec(k=2, covariates=("flag",), caliper=0.5))
    labels = dict(zip(df.person_id, df.label))
    got = found.matched.select("person_id", "label", "pair_id").toPandas()
    assert all(labels[i] == y for i, y in zip(got.person_id, got.label))
    # Each pair has one control and up to two cases, since the rare controls chose.
    assert (got[got.label == 0].groupby("pair_id").size() == 1).all()


def test_ids_beyond_double_precision(spark):
    """Ids that differ only below the precision of a double are different cases."""
    base = 1 << 60
    rows = [(base + i, int(i < 3), "s", 0.5 * (i % 3), 0.4, 40.0) for i in range(9)]
    df = spark.createDataFrame(rows, "person_id long, label int, stratum string, logit_ps double, caliper double, age double")
    got = {(r.case_id, r.control_id) for r in matching.greedy_match(df, 1).collect()}
    assert got == {(base + i, base + i + 3) for i in range(3)}
    assert got == {(r.case_id, r.control_id) for r in matching.greedy_match(df, 1, max_rows=4).collect()}


@pytest.mark.parametrize("digits", [0, 1])
def test_nearest_candidates_prefer_low_ids_on_both_sides(spark, digits):
    df = people(120, 11, digits=digits)
    df["logit_ps"] = df.logit_ps + 0.25 * df.label
    expected = set()
    for _, c in df[df.label == 1].iterrows():
        near = df[df.label == 0].assign(d=(df.logit_ps - c.logit_ps).abs())
        near = near[near.d <= c.caliper].sort_values(["d", "person_id"]).head(2)
        expected |= {(int(c.person_id), int(p), i + 1) for i, p in enumerate(near.person_id)}
    got = matching.nearest_candidates(spark.createDataFrame(df), 2).collect()
    assert {(r.case_id, r.control_id, r["rank"]) for r in got} == expected


def test_ratio_sweep_ends_each_ratio_before_the_next(spark):
    df = people(60, 4).drop(columns=["stratum", "logit_ps", "caliper"]).assign(flag=lambda d: d.person_id % 2)
    spec = MatchSpec(caliper=0.5, covariates=("flag",), age_squared=False)
    out = matched_cohort.ratio_sweep(spark.createDataFrame(df), spec, [1, 2])
    assert {r.k: r.n_cases > 0 for r in out.collect()} == {1: True, 2: True}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_estimated_size_does_not_grow_with_the_rounds(spark):
    """The plan of a round starts from files: estimates of estimates, multiplied by every join, filled the driver."""
    df = people(120, 7, 1, case_share=0.3)
    out = matching.greedy_match(spark.createDataFrame(df), 2, max_rows=40)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 100
    assert {(r.case_id, r.control_id) for r in out.collect()} == sequential(df, 2)


def test_a_case_that_loses_its_control_proposes_again_in_the_same_round():
    rows = [(True, 1, 0.0, 1), (True, 2, 0.1, 0), (True, 3, 0.2, 0), (False, 11, 0.0, 2), (False, 12, 0.15, 3), (False, 13, 0.3, matching.FREE)]
    frame = pd.DataFrame(
        [{"is_case": c, "id": i, "ord": i, "z": z, "need": need if c else 0, "holder": matching.FREE if c else need} for c, i, z, need in rows]
    ).assign(stratum="s", u=0.5, age=40.0, caliper=1.0, left_open=False, right_open=False)
    out = matching.settle_piece(frame, 1, None)
    assert {(r.id, r.holder) for r in out.itertuples()} == {(11, 1), (12, 2), (13, 3)}


def test_persons_are_not_broadcast_to_their_pairs(spark):
    persons = spark.createDataFrame(people(200, 5))
    pairs = matching.greedy_match(persons, 2)
    out = matching.matched_long(persons, pairs)
    assert out.count() == pairs.count() + pairs.select("case_id").distinct().count()
    out.collect()
    assert re.search(r"(\w+Join)", out._jdf.queryExecution().executedPlan().toString()).group(1) == "SortMergeJoin"
