"""Aggregations, pivots and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import cumulated_sql, query, rounded
from pairwell.functions import expressions as E
from pairwell.operators import joins, metrics, reshape
from pairwell.plans import matched_cohort


@query("A1", "select fold, person_id, max(truth) as truth, round(avg(score), 6) as score from {predictions} group by fold, person_id")
def chunk_scores_to_persons(t):
    return rounded(reshape.pool_chunks(t.predictions, "person_id", "truth", "score", ["fold"]))


@query("A2", "select person_id, cast(max(truth) as int) as y, round(avg(score), 6) as p, round(avg(weight), 6) as w from {predictions} group by person_id")
def fold_scores_to_persons(t):
    return rounded(reshape.pool_folds(t.predictions, "person_id", "truth", "score", "weight"))


FOLD_AUROC_SQL = (
    "with "
    + cumulated_sql("{predictions}", "truth", "score", "weight", "fold")
    + """,
wa as (select fold, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as weighted_auroc from cum group by fold),"""
    + cumulated_sql("{predictions}", "truth", "score", "1.0", "fold").replace("mass", "mass1").replace("cum as", "cum1 as")
    + """,
ua as (select fold, sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)) as auroc from cum1 group by fold),
folds as (select fold, auroc, weighted_auroc from ua join wa using (fold))"""
)


def fold_aurocs(t):
    plain = metrics.auroc(t.predictions, "truth", "score", None, ["fold"])
    weighted = metrics.auroc(t.predictions, "truth", "score", "weight", ["fold"], out="weighted_auroc")
    return plain.join(weighted, "fold")


@query(
    "A3",
    FOLD_AUROC_SQL
    + """ select round(avg(auroc), 6) as auroc_mean, round(stddev_pop(auroc), 6) as auroc_std,
    round(avg(weighted_auroc), 6) as weighted_auroc_mean, round(stddev_pop(weighted_auroc), 6) as weighted_auroc_std from folds""",
)
def fold_summary(t):
    return rounded(reshape.fold_summary(fold_aurocs(t), ["auroc", "weighted_auroc"]))


@query(
    "A4",
    FOLD_AUROC_SQL
    + """, c as (select fold, min(floor(score * 2)) = max(floor(score * 2)) as constant from {predictions} group by fold)
    select count(*) as n_folds, count(*) filter (constant) as n_constant_folds, round(avg(weighted_auroc), 6) as fold_wauroc_mean,
      round(stddev_samp(weighted_auroc), 6) as fold_wauroc_sd, round(avg(auroc), 6) as fold_auroc_mean,
      round(stddev_samp(auroc), 6) as fold_auroc_sd from folds join c using (fold)""",
)
def fold_statistics(t):
    coarse = t.predictions.withColumn("half", F.floor(F.col("score") * 2))
    all_folds = lambda df: df.withColumn("run", F.lit(1))
    return rounded(reshape.fold_stats(all_folds(fold_aurocs(t)), all_folds(coarse), "half", ["run"], "fold").drop("run"))


@query(
    "A5",
    FOLD_AUROC_SQL + " select round(stddev_samp(weighted_auroc - auroc), 6) as fold_diff_sd, count(*) as n from folds",
)
def fold_difference_sd(t):
    differences = joins.fold_membership_differences(t.predictions, t.predictions.where("score is not null"), "fold", "person_id")
    folds = fold_aurocs(t)
    a = folds.select("fold", F.col("weighted_auroc").alias("m"))
    b = folds.select("fold", F.col("auroc").alias("m"))
    return rounded(reshape.fold_difference_sd(a, b, "fold", "m", differences))


@query(
    "A6",
    """with r as (select classifier_name, user_id as seed, avg(wauroc) as wauroc, avg(wauroc) - 0.1 as lo, avg(wauroc) + 0.1 as hi,
         avg(wauroc) - 0.62 as diff, avg(wauroc) - 0.65 as diff_lo from {runs} group by all)
       select classifier_name, count(*) as n_seeds, round(max(wauroc) filter (seed = 42), 6) as seed_wauroc,
         round(max(lo) filter (seed = 42), 6) as seed_lo, round(max(hi) filter (seed = 42), 6) as seed_hi,
         round(avg(wauroc), 6) as wauroc_mean, round(min(wauroc), 6) as wauroc_min, round(max(wauroc), 6) as wauroc_max,
         count(*) filter (wauroc < 0.5) as n_below_half, round(avg(diff), 6) as diff_mean, count(*) filter (diff_lo > 0) as n_diff_above_0
       from r group by classifier_name""",
)
def summary_over_seeds(t):
    r = t.runs.groupBy("classifier_name", F.col("user_id").alias("seed")).agg(F.avg("wauroc").alias("wauroc"))
    r = r.withColumns(
        {
            "wauroc_lo": F.col("wauroc") - 0.1, "wauroc_hi": F.col("wauroc") + 0.1,
            "diff": F.col("wauroc") - 0.62, "diff_lo": F.col("wauroc") - 0.65,
        }
    )
    return rounded(reshape.seed_summary(r, ["classifier_name"]))


@query(
    "A7",
    """select p_partkey, 'd1' as recording_number, p_name as date from part where p_partkey % 2 = 0
       union all select p_partkey, 'd2', p_brand from part where p_partkey % 3 = 0 union all select p_partkey, 'd3', p_type from part""",
)
def melt_wide_dates(t):
    wide = t.part.select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("d1"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("d2"), F.col("p_type").alias("d3"),
    )
    return reshape.melt(wide, ["p_partkey"], ["d1", "d2", "d3", "d4"], "recording_number", "date")


CROSSTAB_SQL = """with c as (select {row} as row, {col} as col, count(*) as n from {table} group by all),
m as (select case when grouping(row) = 1 then 'All' else row end as row, case when grouping(col) = 1 then 'All' else col end as col,
  cast(sum(n) as bigint) as n from c group by cube (row, col))
select row, col, n, round(n * 100.0 / max(case when col = 'All' then n end) over (partition by row), 6) as row_pct from m"""


@query("A8", CROSSTAB_SQL.replace("{row}", "segment").replace("{col}", "language").replace("{table}", "{persons}"))
def crosstab_with_margins(t):
    return rounded(reshape.crosstab(t.persons, "segment", "language"))


MATRIX_SQL = """with f as (select wauroc, split_part(run_name, '__', 3) as v, split_part(run_name, '__', 6) as s from {runs}
    where run_name like 'norm%' and split_part(run_name, '__', 2) = 'voice_only'),
g as (select wauroc, case when v like 'wav2vec%' then 'wav2vec2' when v like '%spectral' then 'Spectral' when v like '%basic_acoustics' then 'Basic acoustics'
    when v like '%egemaps' then 'eGeMAPS' when v like '%temporal' then 'Temporal' when v like '%all_features' then 'All acoustic' end as c,
  case when v like '%poem%' then case when s = 'split' then 'poem chunked' else 'poem unchunked' end when v like '%all_vowels%' then 'all vowels'
    when v like 'parsel_a_%' or v = 'wav2vec_a' then 'vowel /a/' when v like 'parsel_i_%' then 'vowel /i/' when v like 'parsel_o_%' then 'vowel /o/' end as r from f),
a as (select r, c, printf('%.3f +/- %.3f', avg(wauroc), stddev_samp(wauroc)) as x from g where c is not null and r is not null and wauroc is not null group by r, c)
select r as table_row, max(x) filter (c = 'Spectral') as "Spectral", max(x) filter (c = 'Basic acoustics') as "Basic acoustics",
  max(x) filter (c = 'eGeMAPS') as "eGeMAPS", max(x) filter (c = 'Temporal') as "Temporal", max(x) filter (c = 'All acoustic') as "All acoustic",
  max(x) filter (c = 'wav2vec2') as wav2vec2 from a group by r"""


@query("A9 A28", MATRIX_SQL)
def run_matrix(t):
    named = t.runs.select("wauroc", *[c.alias(n) for n, c in E.run_name_parts(F.col("run_name")).items()])
    cells = named.where("scope = 'voice_only'").withColumns(E.table_cell(F.col("feat_variant"), F.col("splitting")))
    cells = cells.where("table_row is not null and table_col is not null")
    columns = ["Spectral", "Basic acoustics", "eGeMAPS", "Temporal", "All acoustic", "wav2vec2"]
    return reshape.matrix(cells, "table_row", "table_col", columns, "wauroc", "mean_std")


@query(
    "A10",
    """with r as (select user_id, hyperparam, min(wauroc) filter (status = 'FINISHED') as a, min(wauroc) filter (status = 'RUNNING') as b from {runs} group by all),
       d as (select b - a as d from r where a is not null and b is not null)
       select count(*) as n_pairs, round(avg(d), 6) as delta_mean, round(stddev_samp(d), 6) as delta_sd,
         count(*) filter (d > 0) as n_positive, count(*) filter (d < 0) as n_negative from d""",
)
def paired_scope_delta(t):
    r = t.runs.groupBy("user_id", "hyperparam", "status").agg(F.min("wauroc").alias("wauroc"))
    return rounded(reshape.paired_delta(r, ["user_id", "hyperparam"], "status", "FINISHED", "RUNNING", "wauroc"))


@query(
    "A11 A27",
    "select status, hyperparam, count(*) as n_runs, round(avg(wauroc), 6) as mean, round(stddev_samp(wauroc), 6) as sd, round(max(wauroc), 6) as best from {runs} group by all",
)
def summary_by_level(t):
    return rounded(reshape.level_summary(t.runs, ["status", "hyperparam"], "wauroc"))


@query(
    "A12",
    "select classifier_name, run_id, round(wauroc, 6) as wauroc from {runs} where wauroc is not null qualify row_number() over (partition by classifier_name order by wauroc desc, run_id) = 1",
)
def best_row_per_group(t):
    return rounded(reshape.argmax_rows(t.runs.select("classifier_name", "run_id", "wauroc"), ["classifier_name"], "wauroc", ["run_id"]))


@query(
    "A13",
    """select token, count(*) as n from (select unnest(string_split(x, ',')) as token from (select case when p_partkey % 5 = 0 then null else replace(p_name, ' ', ',') end as x from part) where x is not null
         union all select null from part where p_partkey % 5 = 0) group by token""",
)
def token_counts(t):
    texts = t.part.select(F.when(F.col("p_partkey") % 5 != 0, F.replace("p_name", F.lit(" "), F.lit(","))).alias("x"))
    return reshape.token_counts(texts, "x")


@query(
    "A14",
    """with w as (select score, weight, row_number() over (partition by floor(row_id / 5) order by row_id) - 1 as pos, cast(floor(row_id / 5) as bigint) as run from {predictions})
       select run, cast(pos as int) as pos, round(score, 6) as auroc, round(weight, 6) as weighted_auroc from w""",
)
def explode_parallel_lists(t):
    entry = F.struct("row_id", "score", "weight")
    lists = t.predictions.groupBy(F.floor(F.col("row_id") / 5).alias("run")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    lists = lists.select("run", F.transform("l", lambda s: s["score"]).alias("a"), F.transform("l", lambda s: s["weight"]).alias("b"))
    return rounded(reshape.explode_parallel(lists, ["run"], ["a", "b"], ["auroc", "weighted_auroc"]))


@query(
    "A15",
    """select run_id, 'le65_sex0' as stratum, round(wauroc, 6) as value from {runs} union all select run_id, 'gt75_sex1', round(wauroc / 2, 6) from {runs}""",
)
def stratum_columns_to_rows(t):
    wide = t.runs.select(
        "run_id", F.col("wauroc").alias("auroc_stratum_le65_sex0_mean"), (F.col("wauroc") / 2).alias("auroc_stratum_gt75_sex1_mean"),
        F.lit(1.0).alias("auroc_mean"),
    )
    return rounded(reshape.strata_columns(wide, ["run_id"]))


@query(
    "A16",
    """select 'rows' as figure, count(*) as n from {recordings} union all select 'persons', count(distinct audio_id) from {recordings}
       union all select 'null_longitudinal', count(*) - count(longitudinal) from {recordings} union all select 'null_chunk_number', count(*) - count(chunk_number) from {recordings}
       union all select 'class_' || data_source, count(*) from {recordings} group by data_source""",
)
def dataset_summary(t):
    return reshape.dataset_summary(t.recordings, "audio_id", "data_source", ["longitudinal", "chunk_number"])


@query(
    "A17",
    """select label, 'age' as variable, count(age) as n, round(avg(age), 6) as mean, round(stddev_samp(age), 6) as sd, null::double as pct from {persons} group by label
       union all select label, 'balance', count(balance), round(avg(balance), 6), round(stddev_samp(balance), 6), null from {persons} group by label
       union all select label, 'flag_a', sum(flag_a)::bigint, null, null, round(avg(flag_a) * 100, 6) from {persons} group by label
       union all select label, 'flag_c', sum(coalesce(flag_c, 0))::bigint, null, null, round(avg(coalesce(flag_c, 0)) * 100, 6) from {persons} group by label""",
)
def demographic_table(t):
    continuous = reshape.describe_groups(t.persons, "label", ["age", "balance"])
    flags = reshape.describe_flags(t.persons, "label", ["flag_a", "flag_c"])
    return rounded(continuous.unionByName(flags, allowMissingColumns=True))


@query(
    "A18",
    """with p as (select language, truth, cast(score >= 0.5 as int) as pred from {predictions}), g as (select distinct language from p), l(tr, pred) as (values (0, 0), (0, 1), (1, 0), (1, 1))
       select g.language, l.tr as "true", l.pred, count(p.truth) as n from g cross join l left join p on p.language = g.language and p.truth = l.tr and p.pred = l.pred group by all""",
)
def confusion_by_language(t):
    p = t.predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return reshape.confusion_matrix(p, "truth", "pred", [0, 1], ["language"])


@query("A19", "select language, round(avg(cast(truth = cast(score >= 0.5 as int) as int)), 6) as accuracy, count(*) as n from {predictions} group by language")
def accuracy_by_language(t):
    p = t.predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(reshape.accuracy(p, "truth", "pred", ["language"]))


@query(
    "A20",
    CROSSTAB_SQL.replace("{row}", "language").replace("{col}", "cast(cast(score >= 0.5 as int) as varchar)").replace("{table}", "{predictions}"),
)
def prediction_distribution(t):
    p = t.predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(reshape.crosstab(p, "language", "pred"))


@query(
    "A21",
    """with u as (select cast(floor(vec_id / 10) as bigint) as rec, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
       s as (select rec, dim, avg(v::double) as m, stddev_samp(v::double) as s from u group by all)
       select rec, round(sum(m * (dim + 1)), 6) as mean_sum, round(sum(s * (dim + 1)), 6) as std_sum, count(*) as dims from s group by rec""",
)
def pool_time_steps(t):
    frames = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("rec"), "embedding")
    pooled = reshape.pool_steps(frames, ["rec"], "embedding")
    weighted = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(pooled.select("rec", weighted("mean").alias("mean_sum"), weighted("std").alias("std_sum"), F.size("mean").cast("long").alias("dims")))


@query(
    "A22",
    """select data_source, count(*) filter (label = 1) as cases, count(*) filter (label = 0) as controls, round(count(*) filter (label = 1) / count(*) filter (label = 0), 6) as ratio
       from {recordings} join (select person_id, label from {persons}) on person_id = audio_id where longitudinal = 0 group by data_source""",
)
def class_ratio_by_source(t):
    labelled = t.recordings.join(t.persons.select(F.col("person_id").alias("audio_id"), "label"), "audio_id")
    return rounded(reshape.class_ratio(labelled, "data_source", "label", "longitudinal"))


@query(
    "A23",
    "select coalesce(cast(flag_c as varchar), 'nan') || '|' || age as stratum, count(*) as n from {persons} group by 1 having count(*) < 5",
)
def sparse_strata(t):
    return reshape.sparse_strata(t.persons, ["flag_c", "age"])


@query(
    "A24",
    FOLD_AUROC_SQL
    + """ select 'auroc' as figure, round(quantile_cont(auroc, 0.5), 6) as median, round(min(auroc), 6) as low, round(max(auroc), 6) as high from folds
    union all select 'weighted_auroc', round(quantile_cont(weighted_auroc, 0.5), 6), round(min(weighted_auroc), 6), round(max(weighted_auroc), 6) from folds""",
)
def fold_spread(t):
    return rounded(reshape.fold_spread(fold_aurocs(t), ["auroc", "weighted_auroc"]))


@query(
    "A25",
    """with a as (select label, avg(age) as m, stddev_samp(age) as s, count(*) as n from {persons} group by label),
       v as (select label, 'sex_' || sex as figure, count(*) as n from {persons} group by all
         union all (select label, 'language_' || language, count(*) from {persons} group by all))
       select label, 'age_mean' as figure, round(m, 6) as value, n from a union all select label, 'age_sd', round(s, 6), n from a
       union all select label, figure, null, n from v""",
)
def demographics_by_class(t):
    return rounded(matched_cohort.demographics(t.persons))


@query(
    "A26",
    """select status, count(*) as n, case when status = 'FINISHED' then count(*) - count(distinct run_name) else 0 end as n_repeats from {runs} group by status""",
)
def status_counts(t):
    return reshape.status_counts(t.runs, "status", "run_name", "FINISHED")
