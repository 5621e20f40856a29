"""Propensity scores, calipers, matching and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.catalog.weighting import NEWTON_SQL
from pairwell.functions import expressions as E
from pairwell.operators import matching
from pairwell.operators.propensity import propensity_scores
from pairwell.plans import matched_cohort
from pairwell.plans.matched_cohort import MatchSpec

# The balance of a customer, mapped into (0, 1), serves as a given propensity score.
SCORED_SQL = """sc as (select person_id, label, age, flag_a, flag_b, sex, site, (balance + 1050) / 11100.0 as ps,
    ln(((balance + 1050) / 11100.0) / (1 - (balance + 1050) / 11100.0)) as z, STRATUM as stratum from {persons})"""
KEPT_SQL = """fa as (select stratum, count(*) as n, count(*) filter (label = 1) as t, count(*) filter (label = 0) as c,
    greatest(min(ps) filter (label = 1), min(ps) filter (label = 0)) as lo, least(max(ps) filter (label = 1), max(ps) filter (label = 0)) as hi from sc group by stratum),
ins as (select sc.* from sc join fa using (stratum) where t > 0 and c > 0 and ps >= lo and ps <= hi),
lo as (select stratum, count(*) filter (label = 1) as t, count(*) filter (label = 0) as c, stddev_samp(z) as sd from ins group by stratum),
kept as (select ins.*, CAL * case when sd > 0 then sd else (select stddev_samp(z) from sc) end as cal from ins join lo using (stratum) where t > 0 and c > 0)"""
GREEDY_SQL = """cs as (select stratum, row_number() over (partition by stratum order by person_id) as ord, person_id as cid, z as cz, age as cage, cal from kept where label = 1),
ct as (select stratum, person_id as kid, z as kz, age as kage from kept where label = 0),
step(stratum, n, cid, picked, used) as (
  select distinct stratum, 0::bigint, null::bigint, []::bigint[], []::bigint[] from kept
  union all
  select stratum, ord, cid, p, list_concat(used, p) from (
    select s.stratum, c.ord, c.cid, any_value(s.used) as used,
      coalesce(list(kid order by abs(kz - cz), kid) filter (kid is not null and abs(kz - cz) <= cal AGE and not list_contains(s.used, kid)), [])[1:KK] as p
    from step s join cs c on c.stratum = s.stratum and c.ord = s.n + 1 left join ct k on k.stratum = s.stratum group by s.stratum, c.ord, c.cid)),
pairs as (select stratum, cid as case_id, unnest(picked) as control_id from step where cid is not null)"""
SITE = "cast(sex as varchar)"
FINE = "site || '|' || cast(floor(age / 20) as int)"


def scored(t, exact=("sex",)):
    p = (F.col("balance") + 1050) / 11100.0
    rows = t.persons.withColumns({"ps": p, "logit_ps": F.ln(p / (1 - p)), "age20": F.floor(F.col("age") / 20).cast("int")})
    return matching.with_stratum(rows, exact)


def greedy_sql(stratum: str, caliper: float, k: int, age: str) -> str:
    return (
        "with recursive " + SCORED_SQL.replace("STRATUM", stratum) + ", " + KEPT_SQL.replace("CAL", str(caliper)) + ", "
        + GREEDY_SQL.replace("KK", str(k)).replace("AGE", age)
    )


@query(
    "M1 P25",
    """with recursive st as (select avg(age) as m, stddev_pop(age) as s, avg(label) as pi from {persons}),
       x as (select person_id as id, label as y, case when label = 1 then 0.5 / pi else 0.5 / (1 - pi) end as w, coalesce(flag_c, 0) as x1, (age - m) / (s + 1e-9) as x2 from {persons}, st), """
    + NEWTON_SQL.replace("C * ", "1.0 * ")
    + """ select id as person_id, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 5) as ps, round(b0 + b1 * x1 + b2 * x2, 4) as logit_ps from x, fit""",
)
def propensity_model(t):
    people = propensity_scores(t.persons, "label", ["flag_c"], use_age=True, age_squared=False)
    return people.select("person_id", F.round("ps", 5).alias("ps"), F.round("logit_ps", 4).alias("logit_ps"))


@query("M2", "select person_id, 0.5::double as ps, 0.0::double as logit_ps from {persons}")
def propensity_without_covariates(t):
    return propensity_scores(t.persons, "label", [], use_age=False).select("person_id", "ps", "logit_ps")


@query(
    "M3 M4",
    "with " + SCORED_SQL.replace("STRATUM", SITE) + ", " + KEPT_SQL.replace("CAL", "0.2") + " select person_id, stratum, round(cal, 6) as caliper from kept",
)
def common_support_and_caliper(t):
    return rounded(matching.support_and_caliper(scored(t), 0.2).select("person_id", "stratum", "caliper"))


@query(
    "M5",
    "with " + SCORED_SQL.replace("STRATUM", SITE) + ", " + KEPT_SQL.replace("CAL", "0.2")
    + """ select a.person_id as case_id, a.stratum, count(b.person_id) as n_candidates from kept a left join kept b on a.stratum = b.stratum and b.label = 0
      and b.z >= a.z - a.cal and b.z <= a.z + a.cal where a.label = 1 group by all""",
)
def candidate_counts(t):
    return matching.candidate_counts(matching.support_and_caliper(scored(t), 0.2))


@query(
    "M5",
    "with " + SCORED_SQL.replace("STRATUM", SITE) + ", " + KEPT_SQL.replace("CAL", "0.02")
    + """ select a.person_id as case_id, b.person_id as control_id, round(abs(b.z - a.z), 6) as distance, cast(row_number() over (partition by a.person_id order by abs(b.z - a.z), b.person_id) as int) as rank
      from kept a join kept b on a.stratum = b.stratum and a.label = 1 and b.label = 0 and abs(b.z - a.z) <= a.cal qualify rank <= 3""",
)
def nearest_candidates(t):
    return rounded(matching.nearest_candidates(matching.support_and_caliper(scored(t), 0.02), 3))


@query("M6", greedy_sql(SITE, 0.05, 3, "and abs(kage - cage) <= 12") + " select case_id, control_id, stratum from pairs")
def greedy_matching(t):
    kept = matching.support_and_caliper(scored(t), 0.05)
    return matching.greedy_match(kept, 3, age_caliper=12).select("case_id", "control_id", "stratum")


@query(
    "M7",
    greedy_sql(FINE, 0.3, 2, "and abs(kage - cage) <= 3")
    + """, un as (select * from kept where label = 1 and person_id not in (select case_id from pairs)),
    na as (select count(*) as n from un where not exists (select 1 from kept k where k.stratum = un.stratum and k.label = 0 and abs(k.age - un.age) <= 3))
    select 'no_opposite_label' as reason, coalesce(sum(n), 0)::bigint as n from fa where t = 0 or c = 0
    union all select 'no_support', coalesce(sum(t + c), 0)::bigint from lo where t = 0 or c = 0
    union all select 'empty_after_filter', 0 union all select 'no_ctrl_within_age_caliper', n from na
    union all select 'no_match_within_ps_caliper', (select count(*) from un) - n from na""",
)
def match_drop_reasons(t):
    people = scored(t, ("site", "age20"))
    kept = matching.support_and_caliper(people, 0.3)
    pairs = matching.greedy_match(kept, 2, age_caliper=3)
    return matching.drop_reasons(people, kept, pairs, age_caliper=3)


@query("M8")
def label_swapped_matching(t):
    spec = MatchSpec(k=3, caliper=0.2, exact=("sex",), covariates=("flag_a", "flag_b"), age_squared=False)
    # Few controls per case here: exchange the roles so that the rarer side chooses.
    found = matched_cohort.match_swapped(t.persons.withColumn("label", 1 - F.col("label")), spec)
    return found.matched.select("person_id", "label", "pair_id", "match_ratio_k")


AGE_PAIRS_SQL = """with recursive cs as (select sex, row_number() over (partition by sex order by age, person_id) as ord, person_id as cid, age as ca from {persons} where label = 1),
ct as (select sex, person_id as kid, age as ka from {persons} where label = 0),
step(sex, n, cid, ca, picked, used) as (
  select distinct sex, 0::bigint, null::bigint, null::int, []::bigint[], []::bigint[] from {persons}
  union all
  select sex, ord, cid, ca, p, list_concat(used, p) from (
    select s.sex, c.ord, c.cid, c.ca, any_value(s.used) as used,
      coalesce(list(kid order by abs(ka - c.ca), ka, kid) filter (kid is not null and abs(ka - c.ca) <= 5 and not list_contains(s.used, kid)), [])[1:1] as p
    from step s join cs c on c.sex = s.sex and c.ord = s.n + 1 left join ct k on k.sex = s.sex group by s.sex, c.ord, c.cid, c.ca))
select step.sex, cid as case_id, picked[1] as control_id, ca::double as case_age, ka::double as control_age from step join ct on kid = picked[1] and ct.sex = step.sex where cid is not null and len(picked) > 0"""


@query("M9", AGE_PAIRS_SQL)
def nearest_age_pairs(t):
    return matching.age_pairs(t.persons, "sex", "age", "label", "person_id", 5)


@query("M10")
def matching_ratio_sweep(t):
    spec = MatchSpec(caliper=0.2, exact=("sex",), covariates=("flag_a",), age_squared=False)
    return rounded(matched_cohort.ratio_sweep(t.persons, spec, [1, 2, 3, 4, 5, 6, 7, 8, 10]))


SMD_SQL = """sm(phase, covariate, smd) as (
  select 'before', 'flag_a', (avg(flag_a) filter (label = 1) - avg(flag_a) filter (label = 0)) / sqrt(greatest(((avg(flag_a) filter (label = 1) + avg(flag_a) filter (label = 0)) / 2) * (1 - (avg(flag_a) filter (label = 1) + avg(flag_a) filter (label = 0)) / 2), 1e-12)) from sc
  union all select 'after', 'flag_a', (avg(flag_a) filter (label = 1) - avg(flag_a) filter (label = 0)) / sqrt(greatest(((avg(flag_a) filter (label = 1) + avg(flag_a) filter (label = 0)) / 2) * (1 - (avg(flag_a) filter (label = 1) + avg(flag_a) filter (label = 0)) / 2), 1e-12)) from af
  union all select 'before', 'age', (avg(age) filter (label = 1) - avg(age) filter (label = 0)) / sqrt((var_samp(age) filter (label = 1) + var_samp(age) filter (label = 0)) / 2 + 1e-12) from sc
  union all select 'after', 'age', (avg(age) filter (label = 1) - avg(age) filter (label = 0)) / sqrt((var_samp(age) filter (label = 1) + var_samp(age) filter (label = 0)) / 2 + 1e-12) from af)"""
AFTER_SQL = ", af as (select * from sc where person_id in (select case_id from pairs) or person_id in (select control_id from pairs)), "


@query(
    "M11",
    greedy_sql(SITE, 0.05, 2, "") + AFTER_SQL + SMD_SQL
    + " select covariate, round(max(smd) filter (phase = 'before'), 6) as smd_before, round(max(smd) filter (phase = 'after'), 6) as smd_after from sm group by covariate",
)
def covariate_balance(t):
    people = scored(t)
    pairs = matching.greedy_match(matching.support_and_caliper(people, 0.05), 2)
    return rounded(matching.balance(people, matching.matched_long(people, pairs), ["flag_a"], ["age"]))


@query(
    "M12",
    greedy_sql(SITE, 0.05, 2, "") + AFTER_SQL + SMD_SQL
    + """, q as (select (select count(*) from sc where label = 1) as n_cases_before, count(*) filter (label = 1) as n_cases, count(*) filter (label = 0) as n_controls,
      (select max(abs(smd)) from sm where phase = 'after') as m from af)
    select n_cases_before, n_cases, n_controls, round(100.0 * n_cases / n_cases_before, 6) as case_retention_pct, round(n_controls / n_cases, 6) as effective_ratio,
      round(m, 6) as max_abs_smd, m <= 0.2 and 100.0 * n_cases / n_cases_before >= 80 and n_controls / n_cases >= 2 as quality_passed from q""",
)
def matching_quality_gates(t):
    people = scored(t)
    matched = matching.matched_long(people, matching.greedy_match(matching.support_and_caliper(people, 0.05), 2))
    return rounded(matching.quality(people, matched, matching.balance(people, matched, ["flag_a"], ["age"])))


@query("M13")
def matched_cohort_report(t):
    spec = MatchSpec(k=3, caliper=0.2, exact=("sex",), covariates=("flag_a", "flag_b"))
    return rounded(matched_cohort.match(t.persons, spec).smd)


@query("M13 F14 F16 F19 J8")
def matched_recordings(t):
    diseases = t.persons.select(
        F.col("person_id").alias("audio_id"), "sex", (2025 - F.col("age")).alias("birth_year"),
        E.lookup(F.col("segment"), {"BUILDING": "copd", "MACHINERY": "control", "FURNITURE": "control"}).alias("lung_disease_main"),
    )
    table = t.recordings.join(diseases, "audio_id")
    covariates = t.persons.select(F.col("person_id").alias("audio_id"), "flag_a", "flag_b")
    people = matched_cohort.person_table(table, covariates, "charite", ["flag_a", "flag_b"], ["date", "rec_no"], ["a", "poem"], True)
    found = matched_cohort.match(people, MatchSpec(k=2, caliper=0.5, exact=("sex",), covariates=("flag_a",)), "audio_id")
    return matched_cohort.recordings_of(table, found.matched, "charite").select("rec_no", "audio_id", "recording_category")
