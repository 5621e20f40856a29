"""Filters, contracts, deduplication and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.functions import expressions as E
from pairwell.operators import cohort, contracts, ranking


@query(
    "F1 F2 F3",
    """with b as (select c_custkey, c_nationkey % 2 as control, c_mktsegment as seg,
           case when c_custkey % 9 = 0 then 0 else 1 end as ready,
           case when c_custkey % 2 = 0 then 'control' else 'copd' end as disease,
           case when c_custkey % 13 = 0 then c_name || '?' else c_name end as note from customer)
       select c_custkey, control, disease, note, cast(1 as int) as ready_to_use from b
       where ready = 1 and note not like '%?%'
         and not (control = 1 and disease <> 'control') and not (control = 0 and disease = 'control')""",
)
def ready_rows(t):
    b = t.view(
        """select c_custkey, c_nationkey % 2 as control, case when c_custkey % 9 = 0 then 0 else 1 end as ready_to_use,
             case when c_custkey % 2 = 0 then 'control' else 'copd' end as lung_disease_main,
             case when c_custkey % 13 = 0 then c_name || '?' else c_name end as note from {customer}"""
    )
    checked = cohort.unready_questions(cohort.unready_contradictions(b), ["note"])
    return cohort.ready_only(checked).withColumnRenamed("lung_disease_main", "disease")


@query(
    "F4",
    """with b as (select o_orderkey, case o_orderkey % 50 when 0 then o_orderkey || ',2' when 1 then 'abc' when 2 then o_orderkey || '.5'
           when 3 then '-' || (o_orderkey + 1) when 4 then null else cast(o_orderkey + 1 as varchar) end as audio_id from orders)
       select o_orderkey, audio_id, case o_orderkey % 50 when 0 then 'several ids' when 1 then 'not a number' when 2 then 'not whole'
           when 3 then 'not positive' else 'not a number' end as problem from b where o_orderkey % 50 < 5""",
)
def id_contract_findings(t):
    b = t.view(
        """select o_orderkey, case o_orderkey % 50 when 0 then o_orderkey || ',2' when 1 then 'abc' when 2 then o_orderkey || '.5'
             when 3 then '-' || (o_orderkey + 1) when 4 then null else cast(o_orderkey + 1 as string) end as audio_id from {orders}"""
    )
    return contracts.id_findings(b, "audio_id")


@query(
    "F5",
    """with r as (select *, cast('0x' || substr(md5(audio_id || '_' || recording_category || '_' || date ||
           case when chunk_number is null then '' else '_chunk' || chunk_number end), 1, 8) as bigint) as rid from {recordings}),
       b as (select *, rid + case when rec_no % 20 = 0 then 1 else 0 end as recording_identifier from r)
       select audio_id, recording_identifier, problem from (
         select *, 'audio_id must be positive' as problem from b where audio_id <= 0
         union all select *, 'birth_year outside 1900..2030' from b where rec_no % 17 = 0
         union all select *, 'height_cm outside (0, 300]' from b where rec_no % 19 = 0
         union all select *, 'unknown lung_disease_main' from b where rec_no % 23 = 0
         union all select *, 'longitudinal must be 0 or 1' from b where longitudinal is null
         union all select *, 'chunk_duration_sec not above 0' from b where rec_no % 29 = 0
         union all select *, 'recording_identifier differs from its key' from b where rec_no % 20 = 0)""",
)
def row_contract_findings(t):
    r = t.recordings
    n = F.col("rec_no")
    rid = E.recording_identifier(F.col("audio_id"), F.col("recording_category"), F.col("date"), F.col("chunk_number"))
    table = r.select(
        "audio_id", "audio_sample_path", "recording_category", "data_source", "longitudinal", "date", "chunk_number",
        (rid + F.when(n % 20 == 0, 1).otherwise(0)).alias("recording_identifier"),
        F.when(n % 17 == 0, 1850).otherwise(1960).alias("birth_year"),
        F.when(n % 19 == 0, 0.0).otherwise(170.0).alias("height_cm"),
        F.lit(70.0).alias("weight_kg"),
        F.when(n % 23 == 0, "flu").otherwise("copd").alias("lung_disease_main"),
        F.lit(0.0).alias("chunk_start_sec"),
        F.when(n % 29 == 0, 0.0).alias("chunk_duration_sec"),
    )
    return contracts.row_findings(table)


@query(
    "F6",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
)
def duplicate_identifiers(t):
    return contracts.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "F7 F8",
    """select distinct audio_id from {recordings} where longitudinal = 0
       intersect select audio_id from {recordings} where longitudinal = 1""",
)
def overlapping_groups(t):
    r = t.recordings
    contracts.require_columns(r, ["audio_id", "longitudinal"])
    return contracts.shared_ids(r.where("longitudinal = 0"), r.where("longitudinal = 1"), "audio_id")


@query(
    "F9",
    """select fold, person_id, min(part) as first_part, max(part) as last_part from (
         select fold, person_id, case when row_id % 8 = 0 then 'test' else 'train' end as part from {predictions})
       group by fold, person_id having min(part) <> max(part)""",
)
def leaked_persons(t):
    marked = t.predictions.withColumn("part", F.when(F.col("row_id") % 8 == 0, "test").otherwise("train"))
    return contracts.leaks(marked, "fold", "person_id", "part")


@query("F10", "select person_id, age, flag_c from {persons} where age between 20 and 70 and flag_c is not null")
def age_window(t):
    return cohort.in_range(t.persons.select("person_id", "age", "flag_c"), "age", 20, 70, ["flag_c"])


@query(
    "F11 F18",
    """with s as (select audio_id, data_source = 'charite' as c1, recording_category <> 'i' as c2,
           coalesce(longitudinal = 0, false) as c3, price > 100000 as c4 from {recordings}),
       a as (select count(*) as r0, count(distinct audio_id) as p0,
         count(*) filter (c1) as r1, count(distinct audio_id) filter (c1) as p1,
         count(*) filter (c1 and c2) as r2, count(distinct audio_id) filter (c1 and c2) as p2,
         count(*) filter (c1 and c2 and c3) as r3, count(distinct audio_id) filter (c1 and c2 and c3) as p3,
         count(*) filter (c1 and c2 and c3 and c4) as r4, count(distinct audio_id) filter (c1 and c2 and c3 and c4) as p4 from s)
       select 0 as step, 'start' as operation, r0 as rows_before, r0 as rows_after, 0::bigint as rows_removed, p0 as persons_after from a
       union all select 1, 'source', r0, r1, r0 - r1, p1 from a union all select 2, 'category', r1, r2, r1 - r2, p2 from a
       union all select 3, 'single', r2, r3, r2 - r3, p3 from a union all select 4, 'price', r3, r4, r3 - r4, p4 from a""",
)
def eligibility_attrition(t):
    steps = {
        "source": F.col("data_source") == "charite",
        "category": F.col("recording_category") != "i",
        "single": F.col("longitudinal") == 0,
        "price": F.col("price") > 100000,
    }
    return cohort.cascade(t.recordings, steps, "audio_id")


@query(
    "F12",
    "select rec_no from {recordings} where rec_no in (select l_orderkey from lineitem) and rec_no % 3 <> 0",
)
def existing_voice_files(t):
    catalogue = t.lineitem.select(F.concat(F.lit("/raw/audio/voice_"), F.col("l_orderkey").cast("string"), F.lit(".wav")).alias("path"))
    named = t.recordings.withColumn(
        "audio_sample_path",
        F.when(F.col("rec_no") % 3 == 0, F.replace("audio_sample_path", F.lit("voice_"), F.lit("cough_"))).otherwise(F.col("audio_sample_path")),
    )
    return cohort.voice_files(named, "audio_sample_path", catalogue).select("rec_no")


DURATIONS = """
select '/raw/audio/voice_' || cast(l_orderkey as string) || '.wav' as audio_sample_path,
  case when l_orderkey % 31 = 0 then null else max(l_quantity) / 8 end as duration_sec from {lineitem} group by l_orderkey
"""


@query(
    "F13",
    """with d as (select l_orderkey, case when l_orderkey % 31 = 0 then null else max(l_quantity) / 8 end as s from lineitem group by 1),
       j as (select rec_no, d.l_orderkey as k, s from {recordings} r left join d on rec_no = d.l_orderkey)
       select case when k is null then 'File not found' when s is null then 'Audio processing error' when s < 3 then 'Too short' else 'kept' end as reason,
         count(*) as n, count(distinct rec_no) as n_recordings from j group by 1""",
)
def duration_gate(t):
    kept, rejected = cohort.duration_gate(t.recordings, t.view(DURATIONS), "audio_sample_path", 3.0)
    rows = kept.select("rec_no", F.lit("kept").alias("reason")).unionByName(rejected.select("rec_no", "reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_no").alias("n_recordings"))


@query(
    "F14",
    """with c as (select audio_id from {recordings} where recording_category in ('a', 'i', 'o', 'poem')
         group by audio_id having count(distinct recording_category) = 4)
       select audio_id, count(*) as n from {recordings} where audio_id in (select audio_id from c) group by audio_id""",
)
def complete_recording_sets(t):
    full = cohort.having_all(t.recordings, "audio_id", "recording_category", ["a", "i", "o", "poem"])
    return full.groupBy("audio_id").agg(F.count(F.lit(1)).alias("n"))


@query("F15", "select segment, count(*) as n from {persons} where segment in ('BUILDING', 'MACHINERY') group by segment")
def target_classes(t):
    kept = cohort.member_of(t.persons, "segment", ["BUILDING", "MACHINERY"])
    cohort.require_classes(kept, "segment", ["BUILDING", "MACHINERY"])
    return kept.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F16",
    """select 'exclude' as mode, count(*) as n from {recordings} where longitudinal = 0
       union all select 'only', count(*) from {recordings} where longitudinal = 1
       union all select 'not_one', count(*) from {recordings} where longitudinal is distinct from 1""",
)
def longitudinal_modes(t):
    out = None
    for mode in ("exclude", "only", "not_one"):
        row = cohort.longitudinal(t.recordings, mode).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "F17",
    """select 'chunks' as kind, recording_category, count(*) as n from {recordings} where recording_category <> 'poem' or chunk_number is not null group by all
       union all select 'originals', recording_category, count(*) from {recordings} where recording_category <> 'poem' or chunk_number is null group by all""",
)
def split_or_original(t):
    out = None
    for kind, chunks in (("chunks", True), ("originals", False)):
        part = cohort.split_choice(t.recordings, chunks).groupBy("recording_category").agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(kind).alias("kind"), "recording_category", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "F19",
    "select * from {recordings} qualify row_number() over (partition by audio_id, recording_category order by date, rec_no) = 1",
)
def first_recording(t):
    return cohort.keep_first(t.recordings, ["audio_id", "recording_category"], ["date", "rec_no"])


@query("F20", "select run_name, run_id, start_time from {runs} qualify row_number() over (partition by run_name order by start_time desc) = 1")
def latest_run(t):
    return cohort.keep_latest(t.runs, ["run_name"], "start_time").select("run_name", "run_id", "start_time")


@query(
    "F21",
    """select run_name, run_id, round(wauroc, 6) as wauroc, end_time from {runs}
       qualify row_number() over (partition by run_name order by wauroc is null, end_time desc, run_id) = 1""",
)
def best_run_version(t):
    best = cohort.best_version(t.runs, ["run_name"], "wauroc", "end_time", ["run_id"])
    return rounded(best.select("run_name", "run_id", "wauroc", "end_time"))


@query(
    "F22",
    """select run_id, run_name from {runs} where status = 'FINISHED' and contains(run_name, 'poem') and run_name like 'norm\\_on%' escape '\\'
       and hyperparam is distinct from 'basic' and classifier_name = 'RandomForest'""",
)
def filter_runs(t):
    kept = cohort.run_filter(
        t.runs, "FINISHED", {"run_name": "poem"}, {"run_name": "norm_on"}, {"hyperparam": "basic"}, {"classifier_name": "RandomForest"}
    )
    return kept.select("run_id", "run_name")


@query("F23 F24", "select p_partkey, p_size as egemaps_size, round(p_retailprice, 6) as egemaps_price from part")
def varying_feature_columns(t):
    wide = t.part.select(
        "p_partkey", F.col("p_size").alias("egemaps_size"), F.col("p_retailprice").alias("egemaps_price"),
        F.lit(1.0).alias("egemaps_constant"), F.lit(2).alias("other"),
    )
    group, _ = cohort.feature_group(wide, prefix="egemaps_", keys=["p_partkey"])
    kept, _ = cohort.varying_columns(group, [c for c in group.columns if c != "p_partkey"])
    return rounded(group.select("p_partkey", *kept))


@query("F25", "select count(distinct lang) as n_languages, count(distinct lang) > 1 as compare from documents")
def language_gate(t):
    return contracts.language_gate(t.documents, "lang")


@query(
    "W1",
    "select rec_no, row_number() over (partition by audio_id order by date, rec_no) as temporal_order from {recordings}",
)
def temporal_order(t):
    return ranking.temporal_order(t.recordings, "audio_id", "date", ["rec_no"]).select("rec_no", "temporal_order")


@query(
    "W2",
    """with f as (select user_id, min(event_id) as first_event from events group by user_id)
       select user_id, 3000 + row_number() over (order by first_event) as audio_id from f""",
)
def first_seen_ids(t):
    numbered = ranking.first_seen_ids(t.events.select("user_id", "event_id"), "user_id", ["event_id"], 3001, "audio_id")
    return numbered.select("user_id", "audio_id").distinct()


@query("W3 W5", "select person_id, age, flag_c, balance from {persons}")
def sorted_people(t):
    p = t.persons.select("person_id", "age", "flag_c", "balance")
    return ranking.by_size(ranking.stable_sort(p, ["flag_c", "age", "person_id"]), "balance", ["person_id"])


@query("W3", "select person_id, flag_c, age, row_number() over (order by flag_c nulls last, age nulls last, person_id) - 1 as position from {persons}")
def positions_in_stable_order(t):
    return ranking.sort_positions(t.persons.select("person_id", "flag_c", "age"), ["flag_c", "age", "person_id"], "position")


@query("W5", "select person_id, balance, row_number() over (order by abs(balance) desc nulls last, person_id) - 1 as position from {persons}")
def positions_by_absolute_value(t):
    order = [F.abs("balance").desc_nulls_last(), F.col("person_id").asc_nulls_last()]
    return ranking.sort_positions(t.persons.select("person_id", "balance"), order, "position")


@query("W4", "select run_id, round(wauroc, 6) as wauroc from {runs} order by wauroc desc nulls last, run_id limit 10")
def top_runs(t):
    return rounded(ranking.top_n(t.runs.select("run_id", "wauroc"), "wauroc", 10, ["run_id"]))


@query(
    "W6",
    """select classifier_name, run_id, round(wauroc, 6) as wauroc, row_number() over (partition by classifier_name order by coalesce(wauroc, -1) desc, run_id) as rank
       from {runs}""",
)
def best_per_direction(t):
    best = ranking.best_per_group(t.runs, "classifier_name", "wauroc", ["run_id"], None)
    return rounded(best.select("classifier_name", "run_id", "wauroc", "rank"))


@query(
    "W7",
    """with b as (select l_quantity as a, l_discount as b from lineitem),
       r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra,
         rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from b)
       select round(corr(ra, rb), 6) as spearman, count(*) as n from r""",
)
def rank_correlation(t):
    return rounded(ranking.spearman(t.lineitem.select("l_quantity", "l_discount"), "l_quantity", "l_discount"))


@query("W8", "select rec_no, count(*) over (partition by audio_id) as siblings from {recordings}")
def sibling_counts(t):
    return ranking.sibling_count(t.recordings, "audio_id", "siblings").select("rec_no", "siblings")
