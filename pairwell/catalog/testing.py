"""Hypothesis tests and the random-intercept model."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.functions import expressions as E
from pairwell.operators import stats

# Tail of the chi-square distribution by Simpson's rule after x = s * s, which has no pole at 0.
CHI_TAIL = """1 - (select sum((case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end) * 2 * pow(h * i, dof - 1) * exp(-pow(h * i, 2) / 2) * h / 3)
  / (pow(2, dof / 2.0) * exp(lgamma(dof / 2.0))) from (select sqrt(statistic) / 4000 as h), range(0, 4001) g(i))"""


def chi_sql(source: str, row: str, column: str) -> str:
    return f"""with b as (select {row} as r, {column} as c from {source} where {row} is not null and {column} is not null),
  cell as (select r, c, count(*) as n from b group by all), rr as (select r, sum(n) as nr from cell group by r), cc as (select c, sum(n) as nc from cell group by c),
  g as (select coalesce(n, 0) as n, nr * nc / (select sum(n) from cell) as e from rr cross join cc left join cell using (r, c)),
  d as (select cast((select count(*) - 1 from rr) * (select count(*) - 1 from cc) as int) as dof),
  x as (select sum(pow(abs(n - e) - case when dof = 1 then least(0.5, abs(n - e)) else 0 end, 2) / e) as statistic, any_value(dof) as dof from g, d)
  select round(statistic, 6) as statistic, dof, round({CHI_TAIL}, 6) as p_value from x"""


@query("T1", chi_sql("{predictions}", "language", "cast(score >= 0.5 as int)"))
def chi_square_of_predictions(t):
    p = t.predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(stats.chi_square(p, "language", "pred"))


@query("T1", chi_sql("{persons}", "sex", "label"))
def chi_square_two_by_two(t):
    return rounded(stats.chi_square(t.persons, "sex", "label"))


@query(
    "T2",
    """with t as (select site, count(*) filter (flag_a = 1 and label = 1) as a, count(*) filter (flag_a = 0 and label = 1) as b,
           count(*) filter (flag_a = 1 and label = 0) as c, count(*) filter (flag_a = 0 and label = 0) as d from {persons} group by site),
       k as (select *, unnest(range(greatest(0::bigint, a + c - (c + d)), least(a + b, a + c) + 1)) as k from t),
       m as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
           - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1)) as pk from k),
       o as (select *, max(pk) filter (k = a) over (partition by site) as po from m)
       select site, a, b, c, d, round(case when (a + b) * (c + d) * (a + c) * (b + d) = 0 then null when b * c > 0 then a * d / (b * c) else 'inf'::double end, 6) as odds_ratio,
         round(sum(pk) filter (pk <= po * (1 + 1e-7)), 6) as p_value from o group by site, a, b, c, d""",
)
def fisher_exact_by_site(t):
    cells = stats.two_by_two(t.persons, F.col("label") == 1, F.col("flag_a") == 1, ["site"])
    return rounded(stats.fisher(cells))


@query(
    "T3",
    """with s as (select 'age' as variable, label, age::double as x from {persons} union all select 'balance', label, balance from {persons}),
       a as (select variable, avg(x) filter (label = 1) as m1, stddev_samp(x) filter (label = 1) as s1, count(x) filter (label = 1) as n1,
         avg(x) filter (label = 0) as m0, stddev_samp(x) filter (label = 0) as s0, count(x) filter (label = 0) as n0 from s group by variable),
       w as (select *, (m1 - m0) / sqrt(s1 * s1 / n1 + s0 * s0 / n0) as t, pow(s1 * s1 / n1 + s0 * s0 / n0, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s0 * s0 / n0, 2) / (n0 - 1)) as df from a)
       select variable, round(m1, 6) as mean_case, round(s1, 6) as sd_case, n1 as n_case, round(m0, 6) as mean_control, round(s0, 6) as sd_control, n0 as n_control,
         round(t, 6) as t, round(df, 6) as df,
         round(1 - 2 * (select sum((case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(h * i, 2) / df, -(df + 1) / 2) * h / 3)
           * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) from (select abs(t) / 4000 as h), range(0, 4001) g(i)), 6) as p_value from w""",
)
def welch_tests(t):
    return rounded(stats.welch(t.persons, "label", ["age", "balance"]))


@query(
    "T4",
    """with p as (select run_id, wauroc - 0.39 as p from {runs}), r as (select p, sum(count(*)) over (order by p) as rk, sum(count(*)) over () as m from p where p is not null group by p),
       q as (select p, least(1.0, min(p * m / rk) over (order by p desc)) as q from r)
       select run_id, round(p.p, 6) as p, round(q, 6) as q from p left join q on p.p = q.p""",
)
def adjusted_p_values(t):
    p = t.runs.select("run_id", (F.col("wauroc") - 0.39).alias("p"))
    return rounded(stats.benjamini_hochberg(p, "p", "q"))


FACTORS = {"clf": ("classifier_name", "LogisticRegression"), "status": ("status", "FINISHED")}


def model_rows(t):
    clipped = E.clip(F.col("wauroc"), 0.001, 0.999)
    return t.runs.where("wauroc is not null").withColumns({"y": clipped, "y_logit": E.logit(clipped)})


@query("T5 T6")
def random_intercept_model(t):
    rows = model_rows(t)
    table, facts = stats.random_intercept(rows, "y", "user_id", stats.factor_levels(rows, FACTORS))
    return rounded(table.withColumns({k: F.lit(float(v)) for k, v in facts.items()}).withColumn("sig", E.stars(F.col("p_value"))))


@query("T7 J14 W7")
def logit_response_sensitivity(t):
    rows = model_rows(t)
    levels = stats.factor_levels(rows, FACTORS)
    raw, _ = stats.random_intercept(rows, "y", "user_id", levels)
    transformed, _ = stats.random_intercept(rows, "y_logit", "user_id", levels)
    table, rank = stats.compare_fits(raw, transformed)
    return rounded(table.withColumn("spearman", rank.select("spearman").scalar()))


# The criterion of the model without factors, as a function of the variance ratio r over group sums.
REML = """(sum(n) - 1) * ln((sum(q - R / (1 + R * n) * s * s) - pow(sum(s / (1 + R * n)), 2) / sum(n / (1 + R * n))) / (sum(n) - 1))
    + sum(ln(1 + R * n)) + ln(sum(n / (1 + R * n)))"""


@query(
    "T5 T6",
    """with recursive g as (select user_id, count(*)::double as n, sum(y) as s, sum(y * y) as q from (select user_id, value + (user_id % 17) * 5 as y from events) group by 1),
       it(i, a, b) as (select 0, -12.0::double, 5.0::double union all
         select i + 1, case when f1 < f2 then a else x1 end, case when f1 < f2 then x2 else b end from (
           select any_value(i) as i, any_value(a) as a, any_value(b) as b, any_value(x1) as x1, any_value(x2) as x2, """
    + REML.replace("R", "exp(x1)") + " as f1, " + REML.replace("R", "exp(x2)")
    + """ as f2 from (select i, a, b, b - 0.6180339887498949 * (b - a) as x1, a + 0.6180339887498949 * (b - a) as x2 from it where i < 60) cross join g) where i is not null),
       r as (select exp((a + b) / 2) as r from it order by i desc limit 1),
       f as (select any_value(r) as r, sum(n) as n, sum(s / (1 + r * n)) as xy, sum(n / (1 + r * n)) as xx, sum(q - r / (1 + r * n) * s * s) as yy from g, r),
       e as (select r, xy / xx as b, (yy - xy * xy / xx) / (n - 1) as v, xx from f)
       select 'Intercept' as term, round(b, 4) as estimate, round(sqrt(v / xx), 4) as se, round(r * v, 2) as group_var, round(v, 2) as residual_var, round(r / (1 + r), 4) as icc from e""",
)
def random_intercept_only(t):
    rows = t.events.select("user_id", (F.col("value") + (F.col("user_id") % 17) * 5).alias("y"))
    table, facts = stats.random_intercept(rows, "y", "user_id", {})
    return table.select(
        "term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"),
        *[F.round(F.lit(float(facts[k])), d).alias(k) for k, d in (("group_var", 2), ("residual_var", 2), ("icc", 4))],
    )
