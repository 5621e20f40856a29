"""Feature preparation and model training.

Logistic models of two covariates are stated in SQL as Newton steps keyed by fold and penalty; block projections and
trees are not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import cumulated_sql, query, rounded
from pairwell.catalog.samples import HASH
from pairwell.catalog.weighting import STRATA_SQL
from pairwell.operators import contracts, metrics, sampling, weights
from pairwell.plans import crossfit, training
from pairwell.plans.crossfit import Recipe
from pairwell.plans.preparation import fit_preparation


def samples(t):
    """Vectors with a binary label, two samples per person."""
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 2).alias("person_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"),
        (F.floor(F.col("vec_id") / 2) % 3 == 0).cast("int").alias("y0"),
    ).withColumn("v", F.transform("v", lambda x, i: F.when(i == 0, x + F.col("y0") * 0.3).otherwise(x)))


@query("L8 L9", "with l as (select segment, row_number() over (order by segment) - 1 as i from (select distinct segment from {persons})) select rec_no, cast(i as int) as class_idx from {recordings} join {persons} on person_id = audio_id join l using (segment)")
def encoded_labels_per_sample(t):
    people = training.encode_labels(t.persons, "segment", "class_idx").withColumnRenamed("person_id", "audio_id")
    return training.labels_for_samples(t.recordings.select("rec_no", "audio_id"), people, "audio_id", "class_idx").select("rec_no", "class_idx")


@query(
    "L10",
    """select person_id, age::double as age, case when sex = 1 then 1.0 else 0.0 end::double as sex,
         case flag_a + flag_b + coalesce(flag_c, 0) when 0 then 0 when 1 then 1 when 2 then 1 else 2 end::double as comorbidity_count_bin from {persons}""",
)
def baseline_feature_scope(t):
    people = t.persons.withColumn("sex", F.when(F.col("sex") == 1, "m").otherwise("w"))
    return training.scope_features(people, "age_sex_comorbidities", ["flag_a", "flag_b", "flag_c"], ["person_id"])


@query(
    "L1",
    """with u as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as d, cast(floor(vec_id / 2) as bigint) % 3 = 0 as y from embeddings),
       x as (select vec_id, d, v + case when d = 1 and y then 0.3 else 0 end as v from u),
       s as (select d, avg(v) as m, stddev_pop(v) as s from x group by d having var_pop(v) > 0.01)
       select vec_id, count(*) as n, round(sum((v - m) / s * d), 4) as weighted from x join s using (d) group by vec_id""",
)
def standardized_features(t):
    rows = samples(t)
    prepared = fit_preparation(rows, "v", [32, 32])
    positions = F.array(*[F.lit(float(i + 1)) for i in prepared.kept])
    scaled = rows.select("vec_id", prepared.scaled(F.col("v")).alias("x"))
    total = F.aggregate(F.zip_with("x", positions, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rounded(scaled.select("vec_id", F.size("x").cast("long").alias("n"), total.alias("weighted")), 4)


@query("L2")
def block_projection(t):
    from pyspark.ml.functions import vector_to_array

    prepared = fit_preparation(samples(t), "v", [32, 30, 2], {0: 4, 1: 3}, minimum_variance=0.0)
    out = prepared.apply(samples(t), "v").select("vec_id", vector_to_array("features").alias("f"))
    return out.select("vec_id", F.size("f").alias("n"), F.aggregate(F.transform("f", lambda x: F.abs(x)), F.lit(0.0), lambda a, b: a + b).alias("size"))


@query(
    "L1",
    """with u as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
       h as (select dim, case when dim = 3 or (vec_id + dim) % 5 = 0 then null else v end as v from u)
       select cast(dim as int) as dim, round(quantile_cont(v, 0.5), 6) as median from h group by dim""",
)
def medians_of_dimensions(t):
    """Every fifth cell and all of dimension 3 are missing."""
    hole = lambda x, i: F.when((i == 3) | ((F.col("vec_id") + i) % 5 == 0), None).otherwise(x.cast("double"))
    rows = t.embeddings.select(F.transform("embedding", hole).alias("v"))
    found = training.dimension_medians(rows, "v")
    return rounded(t.spark.createDataFrame(list(enumerate(found)), "dim int, median double"))


def people(t):
    """Two covariates for each sample, the first sometimes missing; a fifth of the persons has two samples."""
    age = F.when(F.col("person_id") % 11 != 0, F.col("age").cast("double"))
    base = t.persons.select("person_id", F.col("label").alias("y"), "age", "sex", age.alias("a"), F.col("site").cast("double").alias("b"))
    both = base.unionByName(base.where("person_id % 5 = 0").withColumn("b", F.col("b") + 1))
    return both.withColumn("v", F.array("a", "b"))


TWO = Recipe("LogisticRegression", "v", (2,))

PEOPLE_SQL = """base0 as (select person_id as id, label as y, age, sex, case when person_id % 11 <> 0 then age::double end as a, site::double as b from {persons}),
base as (select * from base0 union all select * replace (b + 1 as b) from base0 where id % 5 = 0)"""


def weighted_sql(name: str, source: str, key: str = "") -> str:
    """Balanced class weights, shared out over the rows of a person, within ``key``."""
    k = f"{key}, " if key else ""
    part = f"partition by {key}" if key else ""
    return f"""{name} as (select *, (case when y = 1 then 0.5 / (pi + 1e-12) else 0.5 / (1 - pi + 1e-12) end) / count(*) over (partition by {k}id) as w
      from (select *, avg(y) over ({part}) as pi from {source}))"""


def folds_sql(name: str, source: str, k: int, repeats: int, seed: str = "42", key: str = "") -> str:
    """``repeat, fold`` of each id, as the library draws them; ``seed`` may depend on ``key``."""
    keys = f"{key}, " if key else ""
    seed = f"(({seed}) || '-' || g.r)"
    return f"""{name} as (select {keys}id, cast(repeat as int) as repeat, cast(repeat * {k} + (row_number() over (partition by {keys}repeat, y order by h, id) - 1) % {k} + 1 as int) as fold
      from (select {keys}id, y, g.r as repeat, {HASH.format(seed=seed, unit="id")} as h from (select distinct {keys}id, y from {source}), range(0, {repeats}) g(r)))"""


def models_sql(n: str, train: str, test: str, costs: str, keys: str = "m") -> str:
    """``score{n}``: the rows of ``test`` scored by the models that are keyed by ``keys`` and penalty ``c``.

    Median fill, weighted scale and Newton steps per model, from ``train``.
    """
    on = f"using ({keys})"
    return f"""md{n} as (select {keys}, quantile_cont(a, 0.5) as ma, quantile_cont(b, 0.5) as mb from {train} group by {keys}),
    fl{n} as (select {keys}, y, w, coalesce(a, ma) as a, coalesce(b, mb) as b from {train} join md{n} {on}),
    ms{n} as (select {keys}, sum(w * a) / sum(w) as aa, sum(w * b) / sum(w) as ab, sqrt(sum(w * a * a) / sum(w) - (sum(w * a) / sum(w)) ** 2) as sa,
      sqrt(sum(w * b * b) / sum(w) - (sum(w * b) / sum(w)) ** 2) as sb from fl{n} group by {keys}),
    x{n} as (select {keys}, y, w, (a - aa) / sa as x1, (b - ab) / sb as x2 from fl{n} join ms{n} {on}),
    newton{n}({keys}, c, i, b0, b1, b2) as (
      select {keys}, c, 0, 0.0::double, 0.0::double, 0.0::double from ms{n}, ({costs}) costs(c)
      union all
      select {keys}, c, i + 1, b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
        b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
        b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
      from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from (
        select {keys}, c, any_value(i) as i, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2,
          c * sum(w * (p - y)) as g0, c * sum(w * (p - y) * x1) + any_value(b1) as g1, c * sum(w * (p - y) * x2) + any_value(b2) as g2,
          c * sum(w * p * (1 - p)) as h00, c * sum(w * p * (1 - p) * x1) as h01, c * sum(w * p * (1 - p) * x2) as h02,
          c * sum(w * p * (1 - p) * x1 * x1) + 1 as h11, c * sum(w * p * (1 - p) * x1 * x2) as h12, c * sum(w * p * (1 - p) * x2 * x2) + 1 as h22
        from (select newton{n}.*, y, w, x1, x2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p from newton{n} join x{n} {on} where i < 10) group by {keys}, c))),
    score{n} as (select t.*, c, 1 / (1 + exp(-(b0 + b1 * (coalesce(a, ma) - aa) / sa + b2 * (coalesce(b, mb) - ab) / sb))) as score
      from {test} t join md{n} {on} join ms{n} {on} join newton{n} {on} where i = 10)"""


#: A tight tolerance, so that the fits equal the statements' Newton steps to some digits.
EXACT = 1e-11
COSTS = {"C": [0.0001, 0.003, 10.0], "tol": [EXACT]}
COSTS_SQL = "values (0.0001::double), (0.003), (10.0)"
#: The folds outside one, and the one, with the rows of all folds of its repeat.
CROSS_SQL = """train as (select o.fold as m, r.* from rows r join folds f using (id) join (select distinct repeat, fold from folds) o on o.repeat = f.repeat and o.fold <> f.fold),
test as (select f.fold as m, r.*, f.repeat from rows r join folds f using (id))"""

VALUES_SQL = cumulated_sql("score1", "y", "score", "w", "c, m") + """,
seg as (select c, m, (nt - nb - wn) / nt as f0, (nt - nb) / nt as f1, (pt - pb - wp) / pt as t0, (pt - pb) / pt as t1 from cum),
cut as (select c, m, f0, least(f1, 0.25) as f1, t0, case when f1 <= 0.25 then t1 else t0 + (t1 - t0) * (0.25 - f0) / (f1 - f0) end as t1 from seg where f0 < 0.25),
cells as (select c, m, sum(case when y = 1 and score > 0.5 then w else 0 end) as tp, sum(case when y = 1 and score <= 0.5 then w else 0 end) as fn,
  sum(case when y = 0 and score > 0.5 then w else 0 end) as fp, sum(case when y = 0 and score <= 0.5 then w else 0 end) as tn from score1 group by c, m),
vals as (select 'auroc' as scorer, c, m, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as v from cum group by c, m
  union all select 'average_prec', c, m, sum(wp / pt * (pt - pb) / (pt - pb + nt - nb)) from cum group by c, m
  union all select 'partial_auroc_weighted', c, m, 0.5 * (1 + (sum((f1 - f0) * (t0 + t1) / 2) - 0.03125) / (0.25 - 0.03125)) from cut group by c, m
  union all select 'balanced_accuracy', c, m, (tp / (tp + fn) + tn / (fp + tn)) / 2 from cells
  union all select 'matthews_corrcoef', c, m, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) from cells)"""


@query(
    "L4 L3 X2",
    "with recursive " + PEOPLE_SQL + ", " + weighted_sql("rows", "base") + ", " + folds_sql("folds", "base", 3, 2) + ", " + CROSS_SQL + ", "
    + models_sql("1", "train", "test", COSTS_SQL) + ", " + VALUES_SQL
    + " select scorer, cast(case c when 0.0001 then 0 when 0.003 then 1 else 2 end as int) as candidate, round(avg(v), 5) as mean_value, count(*) as folds from vals group by scorer, c",
)
def weighted_scorer_search(t):
    """All scorers of a search over repeated folds, from one table of stored scores."""
    rows = weights.fold_weights(people(t), "class_only", "y", "person_id", "w")
    found = crossfit.search(rows, "person_id", TWO, crossfit.expand(COSTS), 3, 2)
    out = None
    for scorer in crossfit.SCORERS:
        part = crossfit.candidate_means(found.scores, scorer).withColumn("scorer", F.lit(scorer))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


ONE_COST_SQL = "values (0.1::double)"
OUT_OF_FOLD_SQL = (
    PEOPLE_SQL + ", " + weighted_sql("rows", "base") + ", " + folds_sql("folds", "base", 5, 1) + ", " + CROSS_SQL + ", " + models_sql("1", "train", "test", ONE_COST_SQL)
)


def own_scores(t):
    rows = weights.fold_weights(people(t), "class_only", "y", "person_id", "w")
    return crossfit.out_of_fold(rows, "person_id", TWO, {"C": 0.1, "tol": EXACT}, 5, keep=["age", "sex", "b"])


@query("L6", "with recursive " + OUT_OF_FOLD_SQL + """ select m as fold, age, count(*) as n, round(sum(w) / count(*), 5) as w, round(sum(score) / count(*), 4) as score, round(sum(score * b) / count(*), 3) as score_b
       from score1 group by m, age""")
def cross_fitted_scores(t):
    """Every row once, scored by the model of the other folds; summed up by fold and age, since fits agree to some digits only."""
    means = own_scores(t).groupBy("fold", "age").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 5).alias("w"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg(F.col("score") * F.col("b")), 3).alias("score_b")
    )
    return means.select("fold", "age", "n", "w", "score", "score_b")


THRESHOLD_SQL = """ select round(threshold, 5) as threshold, round(fpr, 5) as fpr, round(tpr, 5) as tpr from (
  select score as threshold, (nt - nb) / nt as fpr, (pt - pb) / pt as tpr from cum union all select 'inf'::double, 0.0, 0.0) where fpr <= 0.2
  qualify row_number() over (order by round(tpr, 10) desc, threshold desc) = 1"""


@query(
    "L6 E5 G8",
    "with recursive " + OUT_OF_FOLD_SQL + ", people as (select *, y as label from score1), " + STRATA_SQL.replace("MIN", "2")
    + ", q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w), sw as (select w.*, least(greatest(w0, lo), hi) as sw from w, q), "
    + cumulated_sql("sw", "y", "score", "sw") + THRESHOLD_SQL,
)
def cross_fitted_threshold(t):
    own = crossfit.population_weights(own_scores(t), "age", "sex")
    return rounded(crossfit.threshold_from_scores(own, "population_weight"), 5)


@query(
    "L5 L4 L6 E5 F9",
    "with recursive " + PEOPLE_SQL + ", " + folds_sql("outer_", "base", 3, 1)
    + ", tr as (select o.fold as o, r.* from base r join outer_ f using (id) join (select distinct fold from outer_) o on o.fold <> f.fold), "
    + weighted_sql("rows", "tr", "o") + ", " + folds_sql("folds", "tr", 3, 1, "42 + o", "o")
    + """, train as (select o * 100 + g.fold as m, r.* from rows r join folds f using (o, id) join (select distinct o, fold from folds) g using (o) where g.fold <> f.fold),
    test as (select o * 100 + f.fold as m, r.* from rows r join folds f using (o, id)), """
    + models_sql("1", "train", "test", COSTS_SQL) + ", " + cumulated_sql("score1", "y", "score", "w", "c, m")
    + """, best as (select o, c from (select cast(floor(m / 100) as int) as o, c, avg(v) as v from (select c, m, sum(wp / pt * (pt - pb) / (pt - pb + nt - nb)) as v from cum group by c, m) group by 1, c)
      qualify row_number() over (partition by o order by round(v, 9) desc, c) = 1),
    final as (select o as m, * exclude (o) from rows), held as (select f.fold as m, r.*, 1.0 as w from base r join outer_ f using (id)), """
    + models_sql("2", "final", "held", COSTS_SQL)
    + """, own as (select s.*, best.o as oo from score1 s join best on s.o = best.o and s.c = best.c),
    bb as (select *, case when age <= 65 then '<=65' when age <= 75 then '66-75' else '>75' end as b0 from own),
    cc as (select oo, b0, sex, count(*) as n from bb where y = 0 group by all),
    mm as (select oo, case when b0 in ('<=65', '66-75') then '<=75' else b0 end as b1, sex, sum(n) as n from cc group by all),
    lev as (select oo, case when a >= 2 then 0 when z >= 2 then 1 else 2 end as lv from (select oo, min(n) as a from cc group by oo) join (select oo, min(n) as z from mm group by oo) using (oo)),
    gg as (select bb.*, case lv when 0 then b0 when 1 then case when b0 = '>75' then b0 else '<=75' end else '<=75+>75' end as band from bb join lev using (oo)),
    ww as (select *, (case band when '<=65' then 0.361 when '66-75' then 0.341 when '>75' then 0.298 when '<=75' then 0.361 + 0.341 else 0.361 + 0.341 + 0.298 end)
      * (case sex when 1 then 0.537 else 0.463 end) / (count(*) over (partition by oo, y, band, sex) / count(*) over (partition by oo, y)) as w0 from gg),
    qq as (select oo, quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from ww group by oo),
    sw as (select ww.*, least(greatest(w0, lo), hi) as sw from ww join qq using (oo)), """
    + cumulated_sql("sw", "y", "score", "sw", "oo").replace("mass", "mass2").replace("cum as", "cum2 as")
    + """, th as (select oo, threshold from (select oo, score as threshold, (nt - nb) / nt as fpr, (pt - pb) / pt as tpr from cum2 union all select distinct oo, 'inf'::double, 0.0, 0.0 from cum2)
      where fpr <= 0.2 qualify row_number() over (partition by oo order by round(tpr, 10) desc, threshold desc) = 1),
    held2 as (select s.* from score2 s join best on s.m = best.o and s.c = best.c), """
    + cumulated_sql("held2", "y", "score", "1.0", "m").replace("mass", "mass3").replace("cum as", "cum3 as")
    + """ select cast(m as int) as fold, cast(case best.c when 0.0001 then 0 when 0.003 then 1 else 2 end as int) as candidate, round(threshold, 5) as threshold,
      round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 5) as auroc from cum3 join best on best.o = m join th on oo = m group by m, best.c, threshold""",
)
def nested_logistic_validation(t):
    """The whole loop: search by weighted average precision, cross-fitted threshold, scores of the held-out persons."""
    scored = training.nested_predictions(
        people(t).withColumnRenamed("y", "label"), "person_id", "label", TWO, COSTS, outer=3, inner=3, scorer="average_prec", strategy="class_only", age="age", sex="sex"
    )
    facts = scored.groupBy("fold").agg(F.first("candidate").alias("candidate"), F.first("threshold").alias("threshold"))
    return rounded(metrics.auroc(scored, "y", "score", None, ["fold"]).join(facts, "fold"), 5)


def cohort_boot_sql(replicates: int) -> str:
    """Plain resamples of the persons ``pw(id, y, score, sw)``; replicate 0 is the cohort itself."""
    return f"""h as (select *, '_all_' as s, {HASH.format(seed="'42'", unit="id")} as h from pw), rk as (select *, row_number() over (order by h, id) - 1 as r, count(*) over () as n from h),
    dr as (select b, {HASH.format(seed="('42|' || b || '|_all_')", unit="r")} % n as r from rk, range(1, {replicates + 1}) g(b)), mu as (select b, r, count(*) as mult from dr group by all),
    bs as (select b, mult, mult * sw as mw, y, score from mu join rk using (r) union all select 0, 1, sw, y, score from pw)"""


@query(
    "L7 L4 L6 E6 X6",
    "with recursive " + PEOPLE_SQL + ", " + weighted_sql("rows", "(select * from base where id % 2 = 0)") + ", " + folds_sql("folds", "rows", 5, 3) + ", " + CROSS_SQL + ", "
    + models_sql("1", "train", "test", COSTS_SQL) + ", " + cumulated_sql("score1", "y", "score", "w", "c, m")
    + """, means as (select c, avg(v) as v from (select c, m, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as v from cum group by c, m) group by c),
    best as (select c, v from means order by round(v, 9) desc, c limit 1), own as (select s.* from score1 s join best using (c) where repeat = 0), """
    + cumulated_sql("own", "y", "score", "w").replace("mass", "mass2").replace("cum as", "cum2 as")
    + """, th as (select score as threshold from cum2 order by round((pt - pb) / pt + 1 - (nt - nb) / nt, 10) desc, score desc limit 1),
    final as (select 1 as m, * from rows), held as (select 1 as m, *, 1.0 as w from base where id % 2 = 1), """
    + models_sql("2", "final", "held", COSTS_SQL)
    + ", people as (select id, max(y) as label, avg(score) as score, max(age) as age, max(sex) as sex from score2 join best using (c) group by id), " + STRATA_SQL.replace("MIN", "2")
    + ", q as (select quantile_cont(w0, 0.01) as lo, quantile_cont(w0, 0.99) as hi from w), pw as (select id, label as y, score, least(greatest(w0, lo), hi) as sw from w, q), "
    + cohort_boot_sql(2000) + ", "
    + cumulated_sql("bs", "y", "score", "mult", "b").replace("mass", "mass3").replace("cum as", "cum3 as") + ", "
    + cumulated_sql("bs", "y", "score", "mw", "b").replace("mass", "mass4").replace("cum as", "cum4 as")
    + """, f1 as (select b, sum(wp * (nb + wn / 2)) / nullif(sum(wp) * sum(wn), 0) as u from cum3 group by b), f2 as (select b, sum(wp * (nb + wn / 2)) / nullif(sum(wp) * sum(wn), 0) as v from cum4 group by b),
    f3 as (select b, (sum(case when y = 1 and score >= threshold then mult else 0 end) / sum(case when y = 1 then mult end)
      + sum(case when y = 0 and score < threshold then mult else 0 end) / sum(case when y = 0 then mult end)) / 2 as z from bs, th group by b),
    fg as (select * from f1 join f2 using (b) left join f3 using (b))
    select (select cast(case c when 0.0001 then 0 when 0.003 then 1 else 2 end as int) from best) as candidate, (select round(v, 5) from best) as search_value, (select round(threshold, 5) from th) as threshold,
      (select count(*) from pw) as n_test, round(max(u) filter (b = 0), 5) as auroc, round(quantile_cont(u, 0.025) filter (b > 0), 5) as auroc_lo, round(quantile_cont(u, 0.975) filter (b > 0), 5) as auroc_hi,
      round(max(v) filter (b = 0), 5) as weighted_auroc, round(quantile_cont(v, 0.025) filter (b > 0), 5) as weighted_auroc_lo, round(quantile_cont(v, 0.975) filter (b > 0), 5) as weighted_auroc_hi,
      round(max(z) filter (b = 0), 5) as balanced_accuracy, round(quantile_cont(z, 0.025) filter (b > 0), 5) as balanced_accuracy_lo, round(quantile_cont(z, 0.975) filter (b > 0), 5) as balanced_accuracy_hi from fg""",
)
def transfer_between_cohorts(t):
    """Trained on the persons with even ids, judged on those with odd ids."""
    first, second = people(t).where("person_id % 2 = 0"), people(t).where("person_id % 2 = 1")
    _, figures = training.transfer(first, second, "person_id", "y", TWO, COSTS, strategy="class_only", age="age", sex="sex")
    return rounded(figures, 5)


@query("L3 L5 L6 X2 E5")
def nested_cross_validation(t):
    """Outer and inner folds with a projection in the grid, so that it is fitted in every inner fold."""
    grid = {"components": [{0: 4}, {0: 8}], "regParam": [0.01]}
    scored = training.nested_predictions(samples(t), "person_id", "y0", Recipe("LogisticRegression", "v", (64,)), grid, outer=3, inner=3, strategy="class_only")
    return rounded(metrics.auroc(scored, "y", "score", None, ["fold"]))


@query("L4")
def grouped_grid_search(t):
    rows = samples(t).withColumn("y", F.col("y0")).withColumn("w", F.lit(1.0))
    recipe = Recipe("RandomForestClassifier", "v", (64,), {0: 6})
    found = crossfit.search(rows, "person_id", recipe, crossfit.expand({"numTrees": [10], "maxDepth": [2, 4]}), 3, seed=42)
    return rounded(found.means.select("candidate", F.col("mean_value").alias("mean_auroc")))


@query("L7")
def cross_cohort_transfer(t):
    rows = samples(t)
    first, second = rows.where("person_id % 2 = 0"), rows.where("person_id % 2 = 1")
    pooled, _ = training.transfer(first, second, "person_id", "y0", Recipe("GBTClassifier", "v", (64,), {0: 6}), {"maxDepth": [2, 3]}, inner=3, inner_repeats=1, strategy="class_only", replicates=200)
    return rounded(pooled.select("person_id", "y", "score"))
