"""Weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.operators import weights

STRATA_SQL = """b as (select *, case when age <= 65 then '<=65' when age <= 75 then '66-75' else '>75' end as b0 from people),
c as (select b0, sex, count(*) as n from b where label = 0 group by all),
m1 as (select case when b0 in ('<=65', '66-75') then '<=75' else b0 end as b1, sex, sum(n) as n from c group by all),
lev as (select case when (select min(n) from c) >= MIN then 0 when (select min(n) from m1) >= MIN then 1 else 2 end as lv),
g as (select b.*, case lv when 0 then b0 when 1 then case when b0 = '>75' then b0 else '<=75' end else '<=75+>75' end as band, lv from b, lev),
tg as (select *, (case band when '<=65' then 0.361 when '66-75' then 0.341 when '>75' then 0.298 when '<=75' then 0.361 + 0.341 else 0.361 + 0.341 + 0.298 end)
    * case sex when 1 then 0.537 else 0.463 end as pt from g),
w as (select *, pt / (count(*) over (partition by label, band, sex) / count(*) over (partition by label)) as w0 from tg)"""


@query(
    "G1",
    """with p as (select avg(label) as pi from {persons})
       select person_id, round(case when label = 1 then 0.5 / (pi + 1e-12) else 0.5 / (1 - pi + 1e-12) end, 6) as balanced,
         round(case when label = 1 then 0.1 / (pi + 1e-12) else 0.9 / (1 - pi + 1e-12) end, 6) as deployed from {persons}, p""",
)
def class_balance_weights(t):
    balanced = weights.class_weights(t.persons, "label", "balanced")
    return rounded(weights.class_weights(balanced, "label", "deployed", 0.1).select("person_id", "balanced", "deployed"))


# Newton steps of the penalized logistic model with an intercept and two covariates (3 x 3 by Cramer's rule).
NEWTON_SQL = """newton(i, b0, b1, b2) as (
  select 0, 0.0::double, 0.0::double, 0.0::double
  union all
  select i + 1, b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from (
    select any_value(i) as i, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2,
      C * sum(w * (p - y)) as g0, C * sum(w * (p - y) * x1) + any_value(b1) as g1, C * sum(w * (p - y) * x2) + any_value(b2) as g2,
      C * sum(w * p * (1 - p)) as h00, C * sum(w * p * (1 - p) * x1) as h01, C * sum(w * p * (1 - p) * x2) as h02,
      C * sum(w * p * (1 - p) * x1 * x1) + 1 as h11, C * sum(w * p * (1 - p) * x1 * x2) as h12, C * sum(w * p * (1 - p) * x2 * x2) + 1 as h22
    from (select newton.*, x.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p from newton, x where i < 12))
    where i is not null)),
fit as (select b0, b1, b2 from newton order by i desc limit 1)"""


@query(
    "G2",
    """with recursive x as (select person_id as id, label as y, 1.0 as w, case when person_id % 6 = 0 then (select quantile_cont(age, 0.5) from {persons} where person_id % 6 <> 0) else age end / 10.0 as x1,
         sex * 1.0 as x2 from {persons}), """
    + NEWTON_SQL.replace("C * ", "1.0 * ")
    + """ select id as person_id, round(case when y = 1 then 1 - p else p end, 5) as w from (
       select id, y, least(greatest(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 0.05), 0.95) as p from x, fit)""",
)
def overlap_weights(t):
    p = t.persons.select(
        "person_id", "label", "sex", F.when(F.col("person_id") % 6 != 0, F.col("age") / 10.0).alias("age")
    )
    return rounded(weights.overlap_weights(p, "label", ["age", "sex"], "w").select("person_id", "w"), 5)


@query(
    "G3 G9",
    """with r as (select rec_no, audio_id, label, sex, age, count(*) over (partition by audio_id) as k from {recordings}
         join (select person_id, label, sex, age from {persons}) on person_id = audio_id),
       pi as (select avg(label) as pi from r), people as (select * from r), """
    + STRATA_SQL.replace("MIN", "2")
    + """, q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w)
       select rec_no, round(1.0 / k, 6) as flat, round(case when label = 1 then 0.5 / (pi + 1e-12) else 0.5 / (1 - pi + 1e-12) end / k, 6) as class_only,
         round(least(greatest(w0, lo), hi) / k, 6) as strata_only from w, pi, q""",
)
def training_weight_strategies(t):
    r = t.recordings.join(t.persons.select(F.col("person_id").alias("audio_id"), "label", "sex", "age"), "audio_id")
    rows = r.select("rec_no", "audio_id", "label", "sex", "age")
    weighted = [weights.fold_weights(rows, s, "label", "audio_id", s).select("rec_no", s) for s in ("flat", "class_only", "strata_only")]
    return rounded(weighted[0].join(weighted[1], "rec_no").join(weighted[2], "rec_no"))


@query("G3")
def overlap_weight_strategies(t):
    r = t.persons.select("person_id", "label", "sex", "age")
    out = weights.fold_weights(r, "ps_overlap", "label", "person_id", "ps_overlap")
    return rounded(weights.fold_weights(out, "overlap_ps_and_deploy", "label", "person_id", "overlap_ps_and_deploy"))


@query(
    "G4 G5 G8",
    """with people as (select * replace (case when age between 66 and 75 and sex = 0 and label = 0 and person_id % 100 <> 0 then age - 20 else age end as age) from {persons}), """
    + STRATA_SQL.replace("MIN", "5")
    + """, q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w)
       select person_id, band, round(least(greatest(w0, lo), hi), 6) as strata_weight from w, q""",
)
def strata_weights(t):
    # One stratum is left with few controls, so that bands merge; all rows stay.
    moved = F.expr("age between 66 and 75 and sex = 0 and label = 0 and person_id % 100 <> 0")
    people = t.persons.withColumn("age", F.when(moved, F.col("age") - 20).otherwise(F.col("age")))
    return rounded(weights.strata_weights(people, "label", "age", "sex", min_controls=5).select("person_id", "band", "strata_weight"))


@query(
    "G6",
    """with q as (select l_linestatus, quantile_cont(l_extendedprice, 0.01) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lineitem group by 1)
       select l_linestatus, count(*) as n, round(sum(least(greatest(l_extendedprice, lo), hi)) / count(*), 4) as mean,
         round(min(least(greatest(l_extendedprice, lo), hi)), 4) as low, round(max(least(greatest(l_extendedprice, lo), hi)), 4) as high
       from lineitem join q using (l_linestatus) group by l_linestatus""",
)
def percentile_clipping(t):
    clipped = weights.clip_percentiles(t.lineitem, "l_extendedprice", keys=["l_linestatus"])
    return rounded(
        clipped.groupBy("l_linestatus").agg(
            F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"),
            F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        ),
        4,
    )


@query("G7", "select grp, round(pow(sum(weight), 2) / sum(weight * weight), 4) as ess from {audit} group by grp")
def effective_sample_size(t):
    return rounded(t.audit.groupBy("grp").agg(weights.ess(F.col("weight")).alias("ess")), 4)


@query(
    "G10",
    """with p as (select person_id, max(truth) as y, avg(weight) as w, max(age) as a from {predictions} group by 1)
       select round(pow(sum(w) filter (y = 1), 2) / sum(w * w) filter (y = 1), 6) as ess_case, count(*) filter (y = 1) as n_case,
         round(sum(w) filter (y = 1 and a > 65) / sum(w) filter (y = 1), 6) as share_weight_over_case, round(count(*) filter (y = 1 and a > 65) / count(*) filter (y = 1), 6) as share_persons_over_case,
         round(pow(sum(w) filter (y = 0), 2) / sum(w * w) filter (y = 0), 6) as ess_control, count(*) filter (y = 0) as n_control,
         round(sum(w) filter (y = 0 and a > 65) / sum(w) filter (y = 0), 6) as share_weight_over_control, round(count(*) filter (y = 0 and a > 65) / count(*) filter (y = 0), 6) as share_persons_over_control,
         round(sum(w) filter (a > 65) / sum(w), 6) as share_weight_over_all, round(count(*) filter (a > 65) / count(*), 6) as share_persons_over_all from p""",
)
def weight_shares_over_age(t):
    p = t.predictions.groupBy("person_id").agg(F.max("truth").alias("y"), F.avg("weight").alias("w"), F.max("age").alias("a"))
    return rounded(weights.weight_shares(p, "y", "w", "a"))
