"""Joins, set operations, recording sets and vector assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.operators import joins


@query(
    "J1",
    """with c as (select o_custkey as study_id, max(case when o_orderstatus = 'F' then 1 else 0 end) as breathing,
           count(*) as age from orders group by 1)
       select person_id, p.age, coalesce(breathing, 0) as breathing from {persons} p left join c on person_id = study_id""",
)
def covariates_join(t):
    covariates = t.orders.groupBy(F.col("o_custkey").alias("study_id")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("breathing"), F.count(F.lit(1)).alias("age")
    )
    return joins.add_covariates(t.persons.select("person_id", "age"), covariates, "person_id")


@query(
    "J2",
    "select distinct o_custkey as person_id, n_nationkey from orders join (select c_custkey as o_custkey, n_nationkey from customer join nation on c_nationkey = n_nationkey) using (o_custkey)",
)
def id_map_join(t):
    id_map = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person_id"), "n_nationkey"
    )
    return joins.map_ids(t.orders.select(F.col("o_custkey").alias("person_id")), id_map, "person_id")


@query(
    "J3",
    """with m as (select person_id as audio_id, sex from {persons} where person_id % 3 = 0),
       d as (select audio_id, min(date) as date from {recordings} group by 1),
       f as (select audio_id, rec_no from {recordings} where recording_category = 'a')
       select m.audio_id, 0 as longitudinal, sex, date, rec_no from m left join d using (audio_id) left join f using (audio_id)""",
)
def single_recording_join(t):
    main = t.persons.select(F.col("person_id").alias("audio_id"), (F.col("person_id") % 3 > 0).cast("int").alias("longitudinal"), "sex")
    dates = t.recordings.groupBy("audio_id").agg(F.min("date").alias("date"))
    files = t.recordings.where("recording_category = 'a'").select("audio_id", "rec_no")
    return joins.attach_single(main, dates, files)


@query(
    "J4",
    """with m as (select person_id as audio_id, sex from {persons} where person_id % 3 > 0),
       d as (select distinct audio_id, date from {recordings}),
       f as (select audio_id, date, rec_no from {recordings} where recording_category = 'poem')
       select d.audio_id, d.date, 1 as longitudinal, sex, rec_no from d join m using (audio_id) left join f using (audio_id, date)""",
)
def longitudinal_recording_join(t):
    main = t.persons.select(F.col("person_id").alias("audio_id"), (F.col("person_id") % 3 > 0).cast("int").alias("longitudinal"), "sex")
    dates = t.recordings.select("audio_id", "date").distinct()
    files = t.recordings.where("recording_category = 'poem'").select("audio_id", "date", "rec_no")
    return joins.attach_longitudinal(dates, files, main)


@query(
    "J5",
    """with l as (select lower(trim(c_mktsegment)) as k, c_custkey as audio_id from customer
         qualify row_number() over (partition by lower(trim(c_mktsegment)) order by c_custkey) = 1)
       select c_custkey, audio_id from (select c_custkey, lower(trim(' ' || c_mktsegment)) as k from customer) left join l using (k)""",
)
def deduplicated_bridge(t):
    lookup = t.customer.select(F.col("c_mktsegment").alias("sid"), F.col("c_custkey").alias("audio_id"))
    raw = t.customer.select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("raw"))
    return joins.bridge(raw, lookup, "raw", "sid", "audio_id", ["audio_id"]).select("c_custkey", "audio_id")


@query("J6 J13", "select l_orderkey, l_linenumber, l_partkey, p_brand from lineitem left join part on l_partkey = p_partkey")
def attribute_lookup(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.map_values(lines, brands, "l_partkey", "p_brand")


@query(
    "J7",
    """with a as (select person_id, max(truth) as y, avg(score) as p from {predictions} where row_id % 3 <> 0 group by 1),
       b as (select person_id, max(truth) as y, avg(score) as p from {predictions} where row_id % 3 = 0 group by 1)
       select person_id, a.y as y_a, round(a.p, 6) as p_a, b.y as y_b, round(b.p, 6) as p_b from a join b using (person_id)""",
)
def aligned_person_scores(t):
    scores = lambda cond: t.predictions.where(cond).groupBy("person_id").agg(F.max("truth").alias("y"), F.avg("score").alias("p"))
    aligned = joins.align(scores("row_id % 3 <> 0"), scores("row_id % 3 = 0"), "person_id", "y")
    joins.require_same_labels(aligned, "y")
    return rounded(aligned)


@query("J8 A29", "select distinct audio_id from {recordings} where audio_id in (select person_id from {persons} where label = 1) order by 1")
def recordings_of_cases(t):
    cases = t.persons.where("label = 1").select(F.col("person_id").alias("audio_id"))
    from pairwell.operators.reshape import distinct_sorted

    return distinct_sorted(joins.keep_matched(t.recordings, cases, "audio_id"), "audio_id")


@query("J9", "select rec_no from {recordings} where audio_id not in (select person_id from {persons} where site < 5)")
def training_recordings(t):
    held_out = t.persons.where("site < 5").select(F.col("person_id").alias("audio_id"))
    return joins.drop_held_out(t.recordings, held_out, "audio_id").select("rec_no")


@query(
    "J10",
    """select person_id, label, site, balance from {persons} p where exists (select 1 from {persons} q
         where q.label <> p.label and q.site = p.site and abs(q.balance - p.balance) <= 25)""",
)
def persons_with_counterpart(t):
    return joins.with_counterpart(t.persons, "person_id", "label", "site", "balance", 25).select("person_id", "label", "site", "balance")


@query(
    "J11",
    """select audio_id, data_source, null as price_uk, price as price_de from {recordings} where data_source = 'charite'
       union all select audio_id, data_source, price, null from {recordings} where data_source <> 'charite'""",
)
def cohort_union(t):
    r = t.recordings
    a = r.where("data_source = 'charite'").select("audio_id", "data_source", F.col("price").alias("price_de"))
    b = r.where("data_source <> 'charite'").select("audio_id", "data_source", F.col("price").alias("price_uk"))
    return joins.union_cohorts(a, b)


@query(
    "J12",
    """select language, count(*) as n, count(distinct p.person_id) as persons from
         (select person_id, max(truth) as y from {predictions} group by 1) p join {recordings} r on r.audio_id = p.person_id
         join (select person_id as pid, language from {persons}) on pid = p.person_id group by language""",
)
def predictions_with_metadata(t):
    scores = t.predictions.groupBy("person_id").agg(F.max("truth").alias("y"))
    metadata = t.recordings.withColumnRenamed("audio_id", "person_id").select("person_id", "rec_no")
    fanned = scores.join(metadata, "person_id").join(t.persons.select("person_id", "language"), "person_id")
    return fanned.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"))


@query(
    "J15",
    """with a as (select distinct audio_id from {recordings} where longitudinal = 0), b as (select distinct audio_id from {recordings} where longitudinal = 1)
       select audio_id, 'left' as side from a where audio_id not in (select audio_id from b)
       union all select audio_id, 'right' from b where audio_id not in (select audio_id from a)""",
)
def id_set_differences(t):
    r = t.recordings
    return joins.id_differences(r.where("longitudinal = 0"), r.where("longitudinal = 1"), "audio_id")


@query(
    "J16 J19",
    """with i as (select vec_id, cast(floor(vec_id / 8) as bigint) as s, row_number() over (partition by floor(vec_id / 8) order by vec_id desc) as p from embeddings),
       f as (select s, p, vec_id, e.embedding[1] + e.embedding[64] as v from i join embeddings e using (vec_id))
       select s as sample, count(*) * 64 as n, round(sum(v * p), 4) as weighted from f group by s""",
)
def gather_vectors(t):
    base = t.embeddings.select(F.floor(F.col("vec_id") / 8).alias("sample"), "vec_id")
    lists = base.groupBy("sample").agg(F.sort_array(F.collect_list("vec_id"), asc=False).alias("ids"))
    full = joins.gather(lists, "ids", t.embeddings, "vec_id", "embedding", "sample", "v")
    steps = F.sequence(F.lit(0), F.size("ids") - 1)
    ends = F.transform(steps, lambda i: (F.get("v", i * 64).cast("double") + F.get("v", i * 64 + 63).cast("double")) * (i + 1))
    out = full.select("sample", F.size("v").cast("long").alias("n"), F.aggregate(ends, F.lit(0.0), lambda a, x: a + x).alias("weighted"))
    return rounded(out, 4)


@query(
    "J16",
    "select rec_no % 5 as sample, rec_no as vec_id from {recordings} where rec_no not in (select vec_id from embeddings)",
)
def missing_vectors(t):
    lists = t.recordings.select((F.col("rec_no") % 5).alias("sample"), F.array("rec_no").alias("ids"))
    return joins.missing_ids(lists, "ids", t.embeddings, "vec_id", "sample")


@query(
    "J17",
    """with n as (select audio_id, recording_category as c, rec_no, row_number() over (partition by audio_id, recording_category order by date, rec_no) as n from {recordings}),
       a as (select x.audio_id, x.n, [x.rec_no, y.rec_no] as acoustic_ids from n x join n y on x.audio_id = y.audio_id and x.n = y.n and x.c = 'a' and y.c = 'o'),
       e as (select audio_id, n, [rec_no] as embed_ids from n where c = 'poem'),
       b as (select coalesce(a.audio_id, e.audio_id) as audio_id, coalesce(a.n, e.n) as n, acoustic_ids, embed_ids from a full join e on a.audio_id = e.audio_id and a.n = e.n)
       select p.audio_id, coalesce(n, 1) as sample, coalesce(acoustic_ids, []::bigint[]) as acoustic_ids, coalesce(embed_ids, []::bigint[]) as embed_ids
       from (select distinct audio_id from {recordings}) p left join b on p.audio_id = b.audio_id""",
)
def recording_sets(t):
    return joins.recording_sets(t.recordings, ["a", "o"], ["poem"], ["date", "rec_no"], identifier="rec_no")


@query(
    "J18",
    """select vec_id, 64 + 2 as n, round(embedding[1], 6) as first, round(cast(label as double), 6) as last, [64, 2] as sizes from embeddings""",
)
def concatenate_blocks(t):
    blocks = t.embeddings.select("vec_id", "embedding", F.array(F.lit(0.5), F.col("label").cast("double")).alias("demographic"))
    full = joins.concat_blocks(blocks, ["embedding", "demographic"], "v")
    return rounded(
        full.select("vec_id", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"), F.col("v_sizes").alias("sizes"))
    )


@query(
    "J20",
    """with w as (select p.audio_id, c.recording_category from (select distinct audio_id from {recordings} where data_source = 'charite') p, (values ('a'), ('poem')) c(recording_category)),
       f as (select audio_id, recording_category, date from {recordings} qualify row_number() over (partition by audio_id, recording_category order by date, rec_no) = 1)
       select audio_id, recording_category, date, case when date is not null then
         cast('0x' || substr(md5(audio_id || '_' || recording_category || '_' || date), 1, 8) as bigint) end as recording_identifier
       from w left join f using (audio_id, recording_category)""",
)
def original_recording_sets(t):
    r = t.recordings
    persons = r.where("data_source = 'charite'")
    return joins.original_sets(r, persons, ["a", "poem"], ["date", "rec_no"], missing="null")
