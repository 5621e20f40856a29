"""Sources and sinks. Files are written from the given tables and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.catalog.base import query, rounded
from pairwell.functions import vocabulary as V
from pairwell.session import scratch_path
from pairwell.sources import files, runs, tables


@query("S1 S11", "select c_mktsegment, count(*) as n, round(sum(c_acctbal) / count(*), 4) as mean from customer group by 1")
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.customer, path)
    back = tables.read_csv(t.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return rounded(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), 4)


@query("S11", "select c_mktsegment, count(*) as n, count(c_name) as named, round(sum(c_acctbal) / count(*), 4) as mean from customer group by 1")
def json_round_trip(t):
    path = scratch_path(t.spark, "json")
    tables.write_json(t.customer, path)
    back = t.spark.read.schema("c_custkey long, c_name string, c_acctbal double, c_mktsegment string").json(path)
    return rounded(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("c_name").alias("named"), F.avg("c_acctbal").alias("mean")), 4)


@query("S2 J11", "select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1")
def indexed_csv_union(t):
    path = scratch_path(t.spark, "semicolon")
    for part in ("A", "B"):
        rows = t.lineitem.where((F.col("l_orderkey") % 2 == 0) if part == "A" else (F.col("l_orderkey") % 2 == 1))
        rows.select(F.monotonically_increasing_id().alias("idx"), "l_returnflag", "l_quantity").write.option("sep", ";").option("header", True).csv(f"{path}/{part}")
    back = tables.read_indexed_csv(t.spark, [f"{path}/A", f"{path}/B"], "idx long, l_returnflag string, l_quantity double")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "S3",
    "select cast(row_id % 5 as varchar) as run_id, fold, count(*) as n, round(avg(score), 6) as score from {predictions} group by all",
)
def prediction_files_by_run(t):
    path = scratch_path(t.spark, "predictions")
    t.predictions.withColumn("run", F.col("row_id") % 5).write.partitionBy("run").parquet(path)
    back = tables.read_predictions(t.spark, path, r"/run=([^/]+)/")
    return rounded(back.groupBy("run_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")))


STORE_LAYOUT = r"exp=([^/]+)/run=([^/]+)/(?:kind=(params|metrics|tags)/key=([^/]+)|kind=(meta)/key=none)/[^/]+$"


def write_store(t) -> str:
    """One run per 80 parts: parameters, tags, metric histories and a state file, in two generations."""
    path = scratch_path(t.spark, "store")
    brand = t.part.groupBy(F.floor(F.col("p_partkey") / 80).alias("run")).agg(
        F.max("p_type").alias("kind"), F.max("p_size").alias("size"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")))).alias("prices"),
    )
    line = lambda s: F.concat_ws(" ", F.lit("1700000000"), s["v"].cast("string"), s["k"].cast("string"))
    history = F.array_join(F.transform(F.reverse("prices"), line), "\n")
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    entries = F.array(
        entry("params", "classifier_name", F.col("kind")),
        entry("tags", "hyperparam", F.when(F.col("run") % 2 == 0, "extended").otherwise("basic")),
        entry("metrics", "weighted_auroc_mean", F.concat(F.lit("1 0.1 0\n2 0."), F.col("size").cast("string"), F.lit(" 1\n"))),
        entry("metrics", "weighted_auroc", F.concat(history, F.lit("\nbad line\n"))),
        entry(
            "meta", "none",
            F.concat(F.lit("run_id: x\nstatus: "), (F.col("run") % 4 + 1).cast("string"), F.lit("\nstart_time: "), F.col("n").cast("string"), F.lit("\nend_time: 99\n")),
        ),
    )
    rows = brand.withColumn("e", F.explode(entries)).select(
        F.when(F.col("run") % 3 == 0, "old").otherwise("new").alias("exp"), F.col("run").cast("string").alias("run"),
        F.col("e.kind").alias("kind"), F.col("e.key").alias("key"), F.col("e.value").alias("value"),
    )
    both = rows.unionByName(rows.where("kind = 'metrics' and run % 6 = 0").withColumn("exp", F.lit("new")))
    # A file costs milliseconds and has few bytes: with a stated number of tasks they are not put together by bytes.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    both.repartition(tasks, "run").write.partitionBy("exp", "run", "kind", "key").text(path)
    return path


@query(
    "S4 S5",
    """with b as (select cast(floor(p_partkey / 80) as bigint) as run, max(p_type) as kind, max(p_size) as size, count(*) as n from part group by 1)
       select case when run % 3 = 0 then 'old' else 'new' end as experiment, cast(run as varchar) as run_id, case run % 4 + 1 when 1 then 'RUNNING' else 'FINISHED' end as status,
         n as start_time, 99::bigint as end_time, kind as classifier, case when run % 2 = 0 then 'extended' else 'basic' end as hyperparam, cast('0.' || size as double) as wauroc
       from b where run % 4 + 1 in (1, 3)""",
)
def run_store_export(t):
    path = write_store(t)
    table = runs.export_runs(t.spark, [f"{path}/exp=old/", f"{path}/exp=new/"], STORE_LAYOUT)
    return table.select(
        "experiment", "run_id", "status", "start_time", "end_time", F.col("`params.classifier_name`").alias("classifier"),
        F.col("`tags.hyperparam`").alias("hyperparam"), F.col("`metrics.weighted_auroc_mean`").alias("wauroc"),
    )


@query(
    "S6 S7 A14",
    """with b as (select cast(floor(p_partkey / 80) as bigint) as run, p_partkey, p_retailprice from part)
       select case when run % 3 = 0 and run % 6 <> 0 then 'old' else 'new' end as experiment, cast(run as varchar) as run_id, cast(row_number() over (partition by run order by p_partkey) - 1 as int) as pos,
         round(p_retailprice, 6) as value from b""",
)
def metric_histories(t):
    found = runs.metric_history(runs.scan(t.spark, write_store(t), STORE_LAYOUT), ["weighted_auroc"])
    chosen = runs.first_experiment(found, ["new", "old"])
    return rounded(chosen.select("experiment", "run_id", F.posexplode("values").alias("pos", "value")))


@query(
    "S8 W6",
    """with r as (select c_mktsegment as variant, c_nationkey % 3 as d, c_custkey, c_acctbal from customer)
       select 'norm_on' as preproc, variant as cohort_variant, 'd' || d as direction, count(*) as n, round(avg(c_acctbal), 4) as auroc,
         max('norm_on__' || variant || '__d' || d || '_to_test__unsplit__clf' || c_custkey) as last_key from r group by all""",
)
def nested_result_files(t):
    path = scratch_path(t.spark, "results")
    entry = F.struct(
        F.concat(F.lit("d"), (F.col("c_nationkey") % 3).cast("string")).alias("direction"),
        F.concat(F.lit("d"), (F.col("c_nationkey") % 3).cast("string")).alias("train_cohort"),
        F.lit("test").alias("test_cohort"), F.lit("unsplit").alias("splitting"),
        F.concat(F.lit("clf"), F.col("c_custkey").cast("string")).alias("classifier"), F.col("c_acctbal").alias("auroc"),
        F.create_map(F.lit("C"), F.lit(1.0)).alias("best_params"),
    )
    # A document holds the results of at most 20 customers.
    documents = t.customer.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 20)).agg(F.collect_list(entry).alias("results"))
    text = F.to_json(F.struct(F.lit("norm_on").alias("preproc"), F.col("c_mktsegment").alias(V.VARIANT_FIELD), "results"))
    documents.select(text.alias("value")).write.text(path)
    rows = tables.read_results(t.spark, path, "full", one_per_line=True)
    return rounded(
        rows.groupBy("preproc", "cohort_variant", "direction").agg(
            F.count(F.lit(1)).alias("n"), F.avg("auroc").alias("auroc"), F.max("config_key").alias("last_key")
        ),
        4,
    )


@query(
    "S9",
    """select '/x/' || (o_custkey % 10000) || '_' || case o_orderkey % 3 when 0 then 'a' else 'poem' end || case when o_orderkey % 2 = 0 then '_' || strftime(o_orderdate, '%Y%m%d') else '' end || '.wav' as audio_sample_path,
         o_custkey % 10000 as audio_id, case o_orderkey % 3 when 0 then 'a' else 'poem' end as recording_category,
         case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as date, cast(o_orderkey % 2 = 0 as int) as longitudinal from orders where o_orderkey % 7 <> 0""",
)
def file_name_catalogue(t):
    o = t.orders
    good = F.concat(
        F.lit("/x/"), (F.col("o_custkey") % 10000).cast("string"), F.lit("_"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("poem"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(""), F.lit(".wav"),
    )
    bad = F.when(F.col("o_orderkey") % 2 == 0, "/x/12_a_20251399.wav").otherwise("/x/notes.txt")
    return files.parse_names(o.select(F.when(F.col("o_orderkey") % 7 == 0, bad).otherwise(good).alias("path")))


@query(
    "S10 S12",
    "select vec_id as recording_identifier, 128 as n, round(embedding[1] * 3.0, 5) as first, round(embedding[64]::double, 5) as last from embeddings where vec_id % 4 in (1, 3)",
)
def partitioned_embedding_store(t):
    path = scratch_path(t.spark, "embeddings")
    rows = t.embeddings.select(
        F.col("vec_id").alias("recording_identifier"), (F.col("vec_id") % 4).cast("int").alias("layer0"),
        F.transform("embedding", lambda x: x * 3).alias("mean"), F.col("embedding").alias("std"),
    )
    rows = rows.select("recording_identifier", F.when(F.col("layer0") % 2 == 0, 2).otherwise(9).alias("layer"), F.when(F.col("layer0") < 4, "poem").alias("category"), "mean", "std")
    tables.write_embeddings(rows, path)
    back = tables.read_embeddings(t.spark, path, 9, "poem", "mean_std")
    out = back.select("recording_identifier", F.size("vector").alias("n"), F.get("vector", F.lit(0)).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"))
    return rounded(out, 5)


@query("S13", "select r_name, count(n_nationkey) as n from region left join nation on n_regionkey = r_regionkey group by 1")
def sheet_tables(t):
    path = scratch_path(t.spark, "workbook")
    tables.write_parquet(t.region, f"{path}/regions")
    tables.write_csv(t.nation, f"{path}/nations.csv")
    regions = tables.read_sheet(t.spark, path, "regions")
    nations = tables.read_sheet(t.spark, path, "nations.csv")
    joined = regions.join(nations, F.col("r_regionkey") == F.col("n_regionkey").try_cast("int"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query(
    "E14",
    """select event_id as run_id, classifier_name as classifier, cast(e.user_id as varchar) as seed,
         case when classifier_name = 'LogisticRegression' and event_id % 2 = 0 then 'lr_baseline' else 'extended' end as grid,
         case when event_id % 3 > 0 then '[age, v' || e.user_id || ']' end as overlap_covariates_logged
       from events e join (select run_id, classifier_name from {runs}) on run_id = event_id""",
)
def run_information(t):
    table = t.runs.select(
        "run_id", F.col("classifier_name").alias("params.classifier_name"), F.col("user_id").cast("string").alias("params.random_seed"),
        F.when(F.col("run_id") % 2 == 0, "['lbfgs']").otherwise("['saga']").alias("params.classifier_hyperparams.clf__solver"),
    )
    lines = F.concat(F.lit("start\nINFO covariates used: [age, v"), F.col("user_id").cast("string"), F.lit("] for fold 1\nend"))
    logs = t.runs.select("run_id", F.when(F.col("run_id") % 3 > 0, lines).otherwise("nothing").alias("text"))
    return runs.run_info(table, {"classifier": "params.classifier_name", "seed": "params.random_seed"}, logs)
