"""Ranking, threshold and deployment metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import cumulated_sql, query, rounded
from pairwell.catalog.weighting import STRATA_SQL
from pairwell.operators import metrics, sampling, weights
from pairwell.operators.scan import null_safe_join, value_bounds
from pairwell.plans import evaluation
from pairwell.session import durable

AUDIT_CUM = cumulated_sql("{audit}", "y", "score", "weight", "grp")


@query(
    "E1 P16 G4 J6",
    "with people as (select person_id as pid, label, age, sex from {persons}), "
    + STRATA_SQL.replace("MIN", "2")
    + """, q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w),
    sw as (select pid, least(greatest(w0, lo), hi) as sw from w, q),
    pw as (select p.*, sw from {predictions} p join sw on pid = person_id), """
    + cumulated_sql("pw", "truth", "score", "sw", "language")
    + """ select language, round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 6) as weighted_auroc, (select count(*) from pw p2 where p2.language = cum.language) as n from cum group by language""",
)
def weighted_auroc_by_language(t):
    weighted = weights.strata_weights(t.persons.select("person_id", "label", "age", "sex"), "label", "age", "sex", "sw")
    rows = t.predictions.join(weighted.select("person_id", "sw"), "person_id")
    value = metrics.auroc(rows, "truth", "score", "sw", ["language"], value_bounds(t.predictions, "score"), "weighted_auroc")
    # One row for each language, from the few columns that it needs.
    counts = t.predictions.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return rounded(null_safe_join(value, counts, ["language"]))


@query("E1", "with " + AUDIT_CUM + " select grp, round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 6) as auroc from cum group by grp")
def weighted_auroc(t):
    return rounded(metrics.auroc(t.audit, "y", "score", "weight", ["grp"]))


@query(
    "E2",
    "with " + AUDIT_CUM + " select grp, round(sum(wp / pt * (pt - pb) / (pt - pb + nt - nb)), 6) as average_precision from cum group by grp",
)
def average_precision(t):
    return rounded(metrics.average_precision(t.audit, "y", "score", "weight", ["grp"]))


@query(
    "E3",
    "with " + AUDIT_CUM + """, seg as (select grp, (nt - nb - wn) / nt as f0, (nt - nb) / nt as f1, (pt - pb - wp) / pt as t0, (pt - pb) / pt as t1 from cum),
    cut as (select grp, f0, least(f1, 0.2) as f1, t0, case when f1 <= 0.2 then t1 else t0 + (t1 - t0) * (0.2 - f0) / (f1 - f0) end as t1 from seg where f0 < 0.2),
    a as (select grp, sum((f1 - f0) * (t0 + t1) / 2) as a from cut group by grp)
    select grp, round(0.5 * (1 + (a - 0.02) / (0.2 - 0.02)), 6) as partial_auroc from a""",
)
def partial_auroc(t):
    return rounded(metrics.partial_auroc(t.audit, "y", "score", 0.2, "weight", ["grp"]))


PREDICTED_CUM = cumulated_sql("{predictions}", "truth", "floor(score * 100) / 100", "1.0", "language")


@query(
    "E4",
    "with " + PREDICTED_CUM + """, pts as (select language, score, wp, wn, (nt - nb) / nt as fpr, (pt - pb) / pt as tpr,
      lag(wp) over (partition by language order by score) as np, lag(wn) over (partition by language order by score) as nn,
      row_number() over (partition by language order by score desc) as r from cum)
    select language, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(score, 6) as threshold from pts where r = 1 or np is null or np <> wp or nn <> wn
    union all select language, 0.0::double, 0.0::double, 'inf'::double from (select distinct language from pts)""",
)
def roc_rows(t):
    coarse = t.predictions.withColumn("score", F.floor(F.col("score") * 100) / 100)
    points = metrics.roc_points(coarse, "truth", "score", None, ["language"])
    keep_inf = F.when(F.col("threshold") == float("inf"), F.lit(float("inf"))).otherwise(F.round("threshold", 6))
    return points.select("language", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"), keep_inf.alias("threshold"))


ROC_POINTS_SQL = "with " + AUDIT_CUM + """, pts as (select grp, score as threshold, (nt - nb) / nt as fpr, (pt - pb) / pt as tpr from cum
  union all select distinct grp, 'inf'::double, 0.0, 0.0 from cum)"""


@query(
    "E5",
    ROC_POINTS_SQL + """ select grp, round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from pts where fpr <= 0.2
    qualify row_number() over (partition by grp order by tpr desc, threshold desc) = 1""",
)
def threshold_at_false_positive_rate(t):
    points = metrics.roc_points(t.audit, "y", "score", "weight", ["grp"])
    return rounded(metrics.threshold_at_fpr(points, 0.2, ["grp"]))


@query(
    "E6",
    ROC_POINTS_SQL + """ select grp, round(threshold, 6) as threshold, round((tpr + 1 - fpr) / 2, 6) as balanced_accuracy from pts where threshold < 'inf'::double
    qualify row_number() over (partition by grp order by (tpr + 1 - fpr) / 2 desc, threshold desc) = 1""",
)
def threshold_at_balanced_accuracy(t):
    points = metrics.roc_points(t.audit, "y", "score", "weight", ["grp"])
    return rounded(metrics.threshold_at_balanced_accuracy(points, ["grp"]))


CELLS_SQL = """with c as (select grp, sum(case when y = 1 and score >= 0.5 then weight else 0 end) as tp, sum(case when y = 1 and score < 0.5 then weight else 0 end) as fn,
    sum(case when y = 0 and score >= 0.5 then weight else 0 end) as fp, sum(case when y = 0 and score < 0.5 then weight else 0 end) as tn from {audit} group by grp),
r as (select *, tp / (tp + fn) as tpr, fp / (fp + tn) as fpr from c)"""


@query(
    "E7",
    CELLS_SQL + """ select grp, round(tp, 4) as tp, round(fn, 4) as fn, round(fp, 4) as fp, round(tn, 4) as tn, round(tpr, 6) as tpr, round(fpr, 6) as fpr,
      round((tpr + 1 - fpr) / 2, 6) as balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from r""",
)
def weighted_confusion(t):
    predicted = (F.col("score") >= 0.5).cast("int")
    table = metrics.rates(metrics.confusion(t.audit, "y", predicted, "weight", ["grp"]))
    cells = {c: F.round(c, 4) for c in ("tp", "fn", "fp", "tn")}
    return rounded(table.withColumns(cells))


@query(
    "E8",
    CELLS_SQL + """ select grp, round(0.2 * tpr / (0.2 * tpr + 0.8 * fpr), 6) as ppv, round(0.8 * (1 - fpr) / (0.8 * (1 - fpr) + 0.2 * (1 - tpr)), 6) as npv,
      round(1000 * 0.8 * fpr, 4) as fp_per_1000 from r""",
)
def deployment_metrics(t):
    predicted = (F.col("score") >= 0.5).cast("int")
    table = metrics.deployment(metrics.rates(metrics.confusion(t.audit, "y", predicted, "weight", ["grp"])), 0.2)
    return rounded(table.select("grp", "ppv", "npv", F.round("fp_per_1000", 4).alias("fp_per_1000")))


@query(
    "E9",
    """with s as (select *, case when age <= 65 then '<=65' when age <= 75 then '66-75' else '>75' end || '_sex' || sex as stratum from {predictions}), """
    + cumulated_sql("s", "truth", "score", "1.0", "stratum")
    + " select stratum, round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 6) as auroc from cum group by stratum having sum(wp) > 0 and sum(wn) > 0",
)
def stratum_auroc(t):
    return rounded(metrics.stratum_auroc(t.predictions, "truth", "score", "age", "sex"))


@query(
    "E10",
    """with p as (select floor((fold - 1) / 5) as repeat, person_id, avg(score) as p, max(age) as a from {predictions} where truth = 0 group by all),
       r as (select repeat, corr(p, a) as r from p group by repeat having min(a) < max(a))
       select round(avg(r), 6) as mean_r, count(*) as n_repeats, (select count(distinct person_id) from {predictions} where truth = 0) as n_controls from r""",
)
def score_age_correlation(t):
    return rounded(metrics.score_age_correlation(t.predictions, "truth", "score", "age", "person_id", "fold"))


AGE_CUM = cumulated_sql("aged", "truth", "age", "weight", "fold")


@query(
    "E13 J6",
    "with aged as (select fold, person_id, truth, weight, p.age::double as age from (select fold, person_id, truth, weight from {predictions}) join (select person_id, age from {persons}) p using (person_id)), "
    + AGE_CUM + " select fold, round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 6) as auroc from cum group by fold",
)
def covariate_scores(t):
    """Age in place of the score, on the same folds and weights."""
    aged = evaluation.covariate_as_score(t.predictions.drop("age"), t.persons.select("person_id", "age"), "person_id", "age", "score")
    return rounded(metrics.auroc(aged, "truth", "score", "weight", ["fold"]))


BOOT_SQL = """people as (select person_id, max(truth) as y, avg(score) as p, avg(weight) as w, max(age) as age from {predictions} group by 1),
h as (select *, STRATUM as s, cast('0x' || substr(md5('42|' || person_id), 1, 15) as bigint) as h from people),
rk as (select *, row_number() over (partition by s order by h, person_id) - 1 as r, count(*) over (partition by s) as n from h),
dr as (select b, s, cast('0x' || substr(md5('42|' || b || '|' || s || '|' || r), 1, 15) as bigint) % n as r from rk, range(1, REPS + 1) g(b)),
mu as (select b, s, r, count(*) as m from dr group by all),
bs as (select b, person_id, y, p, age, m, m * w as mw from mu join rk using (s, r))"""


@query(
    "X5",
    "with " + BOOT_SQL.replace("REPS", "20").replace("STRATUM", "cast(y as varchar)") + " select b, person_id, m from bs",
)
def stratified_bootstrap_multiplicities(t):
    return sampling.bootstrap(pooled_persons(t), "person_id", 20, ["y"])


def pooled_persons(t):
    return t.predictions.groupBy("person_id").agg(
        F.max("truth").alias("y"), F.avg("score").alias("p"), F.avg("weight").alias("w"), F.max("age").cast("double").alias("age")
    )


def boot_auroc_sql(score: str, name: str) -> str:
    cum = cumulated_sql("bs", "y", score, "mw", "b").replace("mass", f"mass_{name}").replace("cum as", f"cum_{name} as")
    return cum + f", {name} as (select b, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as {name} from cum_{name} group by b having sum(wp) * sum(wn) > 0)"


@query(
    "E11 X8 E13 J7",
    "with " + BOOT_SQL.replace("REPS", "200").replace("STRATUM", "cast(y as varchar)") + ", " + boot_auroc_sql("p", "a1") + ", " + boot_auroc_sql("age", "a2")
    + ", " + cumulated_sql("people", "y", "p", "w").replace("mass", "mp").replace("cum as", "cp as")
    + ", " + cumulated_sql("people", "y", "age", "w").replace("mass", "ma").replace("cum as", "ca as")
    + """, d as (select a1, a2, a1 - a2 as d from a1 join a2 using (b)),
    pt as (select (select sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) from cp) as x, (select sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) from ca) as y)
    select round(any_value(x), 6) as auroc, round(any_value(y), 6) as comparator_auroc, round(any_value(x) - any_value(y), 6) as diff,
      round(quantile_cont(d, 0.025), 6) as diff_lo, round(quantile_cont(d, 0.975), 6) as diff_hi, round(avg(cast(d > 0 as int)), 6) as frac_diff_gt0,
      round(quantile_cont(a1, 0.025), 6) as auroc_lo, round(quantile_cont(a1, 0.975), 6) as auroc_hi,
      round(quantile_cont(a2, 0.025), 6) as comparator_lo, round(quantile_cont(a2, 0.975), 6) as comparator_hi from d, pt""",
)
def bootstrap_comparison(t):
    return rounded(evaluation.compare_scores(pooled_persons(t), "person_id", "y", "p", "age", "w", 200))


@query(
    "X6",
    "with " + BOOT_SQL.replace("REPS", "2000").replace("STRATUM", "'_all_'") + ", " + boot_auroc_sql("p", "a1")
    + " select count(*) as n, round(quantile_cont(a1, 0.025), 6) as lo, round(quantile_cont(a1, 0.975), 6) as hi from a1",
)
def plain_bootstrap_interval(t):
    draws = sampling.bootstrap_auroc(pooled_persons(t), "person_id", "y", ["p"], "w", 2000, stratified=False)
    return rounded(sampling.interval(draws, "p"))


@query(
    "E12",
    "with " + BOOT_SQL.replace("REPS", "2000").replace("STRATUM", "'_all_'") + """, th(threshold) as (values (0.35), (0.4), (0.45)),
    r as (select threshold, b, sum(case when y = 1 and p >= threshold then m end) / sum(case when y = 1 then m end) as tpr,
      coalesce(sum(case when y = 0 and p >= threshold then m end), 0) / sum(case when y = 0 then m end) as fpr from bs, th group by all),
    ba as (select threshold, (coalesce(tpr, 0) + 1 - fpr) / 2 as v from r)
    select threshold::double as threshold, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, count(*) as n from ba group by threshold""",
)
def threshold_sweep_intervals(t):
    persons = pooled_persons(t)
    return rounded(evaluation.threshold_sweep(persons, "person_id", "y", "p", [0.35, 0.4, 0.45], 2000))


@query(
    "X9",
    """select round(quantile_cont(wauroc, 0.05), 6) as q05, round(quantile_cont(wauroc, 0.25), 6) as q25, round(quantile_cont(wauroc, 0.5), 6) as q50,
         round(quantile_cont(wauroc, 0.75), 6) as q75, round(quantile_cont(wauroc, 0.95), 6) as q95, count(wauroc) as n, round(avg(wauroc), 6) as mean,
         round(avg(cast(wauroc <= 0.82 as int)), 6) as frac_le, round(avg(cast(wauroc >= 0.82 as int)), 6) as frac_ge from {runs}""",
)
def quantile_placement(t):
    return rounded(sampling.quantile_placement(t.runs, "wauroc", 0.82))


FOLD_STRATA = """people0 as (select fold, person_id, max(truth) as label, avg(score) as score from {predictions} group by all),
people as (select p.*, age, sex from people0 p join (select person_id, age, sex from {persons}) using (person_id)),
b as (select *, case when age <= 65 then '<=65' when age <= 75 then '66-75' else '>75' end as b0, cast(score >= 0.4 as int) as pred from people),
c as (select fold, b0, sex, count(*) as n from b where label = 0 group by all),
m1 as (select fold, case when b0 in ('<=65', '66-75') then '<=75' else b0 end as b1, sex, sum(n) as n from c group by all),
lev as (select fold, case when a >= 2 then 0 when z >= 2 then 1 else 2 end as lv from (select fold, min(n) as a from c group by fold) join (select fold, min(n) as z from m1 group by fold) using (fold)),
g as (select b.*, case coalesce(lv, 0) when 0 then b0 when 1 then case when b0 = '>75' then b0 else '<=75' end else '<=75+>75' end as band from b left join lev using (fold)),
w as (select *, (case band when '<=65' then 0.361 when '66-75' then 0.341 when '>75' then 0.298 when '<=75' then 0.361 + 0.341 else 0.361 + 0.341 + 0.298 end)
    * (case sex when 1 then 0.537 else 0.463 end) / (count(*) over (partition by fold, label, band, sex) / count(*) over (partition by fold, label)) as w0 from g),
q as (select fold, quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w group by fold),
pr as (select w.*, least(greatest(w0, lo), hi) as sw from w join q using (fold))"""


@query(
    "E1 E2 E7 E8 G8 A1",
    "with " + FOLD_STRATA + ", " + cumulated_sql("pr", "label", "score", "1.0", "fold") + ", "
    + cumulated_sql("pr", "label", "score", "sw", "fold").replace("mass", "mass2").replace("cum as", "cum2 as")
    + """, u as (select fold, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as auroc, sum(wp / pt * (pt - pb) / (pt - pb + nt - nb)) as average_precision from cum group by fold),
    v as (select fold, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as weighted_auroc, sum(wp / pt * (pt - pb) / (pt - pb + nt - nb)) as weighted_average_precision from cum2 group by fold),
    k as (select fold, sum((label = 1 and pred = 1)::int) as tp, sum((label = 1 and pred = 0)::int) as fn, sum((label = 0 and pred = 1)::int) as fp, sum((label = 0 and pred = 0)::int) as tn,
      sum(case when label = 1 and pred = 1 then sw else 0 end) as wtp, sum(case when label = 1 and pred = 0 then sw else 0 end) as wfn,
      sum(case when label = 0 and pred = 1 then sw else 0 end) as wfp, sum(case when label = 0 and pred = 0 then sw else 0 end) as wtn from pr group by fold),
    r as (select *, wtp / (wtp + wfn) as tpr, wfp / (wfp + wtn) as fpr from k)
    select fold, round(auroc, 6) as auroc, round(average_precision, 6) as average_precision, round(weighted_auroc, 6) as weighted_auroc,
      round(weighted_average_precision, 6) as weighted_average_precision, round((tp / (tp + fn) + tn / (fp + tn)) / 2, 6) as balanced_accuracy,
      round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc,
      round((tpr + 1 - fpr) / 2, 6) as weighted_balanced_accuracy, round((wtp * wtn - wfp * wfn) / nullif(sqrt((wtp + wfp) * (wtp + wfn) * (wtn + wfp) * (wtn + wfn)), 0), 6) as weighted_mcc,
      round(0.2 * tpr / nullif(0.2 * tpr + 0.8 * fpr, 0), 6) as ppv, round(0.8 * (1 - fpr) / nullif(0.8 * (1 - fpr) + 0.2 * (1 - tpr), 0), 6) as npv,
      round(800 * fpr, 4) as fp_per_1000 from u join v using (fold) join r using (fold)""",
)
def fold_evaluation(t):
    predictions = evaluation.fold_predictions(
        t.predictions.select("fold", "person_id", "truth", "score"), t.persons, "person_id", "truth", "score", ["fold"], threshold=0.4
    )
    # The predictions table is the hand-over point between training and audit: stored once.
    table = evaluation.fold_metrics(durable(predictions), "truth", "score", ["fold"])
    return rounded(table.withColumn("fp_per_1000", F.round("fp_per_1000", 4)))
