import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.functions import frames
from pairwell.operators import cohort, contracts, joins, reshape
from pairwell.plans import metadata
from pairwell.sources import files, runs, tables


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_dates(spark):
    assert column(spark, ["01/02/2025", "1/2/2025 10:30", "31/02/2025", "2025-01-02", None, "x"], "string", E.iso_date) == [
        "2025-02-01", "2025-02-01", None, None, None, None,
    ]
    assert column(spark, ["01-02-2025 x", "2025-02-01 08:00"], "string", E.year_first) == ["2025-02-01", "2025-02-01"]


def test_ages(spark):
    assert column(spark, ["20-29", "25", " 30 - 39 ", "pnts", "", None, "a-b"], "string", E.age_from_range) == [24, 25, 34, None, None, None, None]
    assert column(spark, [65.0, 65.5, 75.0, 76.0, None], "double", E.band) == ["<=65", "66-75", "66-75", ">75", ">75"]
    assert column(spark, [39, 40], "int", E.decade) == [30, 40]


def test_identifier_follows_the_key(spark):
    df = spark.createDataFrame([(113, "poem", "2025-02-04", 2), (113, "a", "2025-02-04", None)], "p long, c string, d string, k int")
    got = [r[0] for r in df.select(E.recording_identifier(F.col("p"), F.col("c"), F.col("d"), F.col("k"))).collect()]
    md = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    assert got == [md("113_poem_2025-02-04_chunk2"), md("113_a_2025-02-04")]
    bad = column(spark, ["", None, "2025-1-1", "2025-01-01"], "string", lambda c: E.recording_problem(c))
    assert bad == ["date missing", "date missing", "date not YYYY-MM-DD", None]


def test_missing_values_and_modes(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "i int, longitudinal int")
    assert {m: cohort.longitudinal(df, m).count() for m in ("exclude", "only", "not_one")} == {"exclude": 1, "only": 1, "not_one": 2}
    text = spark.createDataFrame([("unbekannt", 1), (" X ", 2), ("/", 3)], "s string, i int")
    assert [r.s for r in frames.trim_lower(frames.null_tokens(text)).orderBy("i").collect()] == [None, "x", None]
    assert column(spark, ["  Lungenfibrose ", "Keine   bekannt", "neu"], "string", E.standard_term) == ["fibrosis", "control", "neu"]


def test_prefixes_are_kept_where_the_name_is_taken(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`params.a` int, a int, `metrics.b` int")
    assert frames.strip_prefixes(df).columns == ["params.a", "a", "b"]


def test_one_hot_refuses_huge_vocabularies(spark):
    df = spark.createDataFrame([("a,b",), ("c",), (None,)], "t string")
    assert frames.one_hot(df, "t").columns == ["t", "a", "b", "c"]
    with pytest.raises(ValueError):
        frames.one_hot(df, "t", limit=2)


def test_first_latest_and_best_rows(spark):
    df = spark.createDataFrame([("k", 3, None, 5), ("k", 1, 0.5, 1), ("k", 2, 0.6, 1)], "k string, i int, m double, t int")
    assert cohort.keep_first(df, ["k"], ["i"]).first().i == 1
    assert cohort.keep_latest(df, ["k"], "t").first().i == 3
    assert cohort.best_version(df, ["k"], "m", "t", ["i"]).first().i == 1
    with pytest.raises(ValueError):
        cohort.keep_first(df, ["k"], [])


def test_contract_findings(spark):
    df = spark.createDataFrame([("1,2",), ("x",), ("1.5",), ("0",), ("7",)], "a string")
    assert sorted(r.problem for r in contracts.id_findings(df, "a").collect()) == ["not a number", "not positive", "not whole", "several ids"]
    with pytest.raises(contracts.ContractError):
        contracts.require_empty(df, "rows")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["a", "b"])


def test_nearest_values_match_brute_force(spark):
    rng = np.random.default_rng(0)
    w, o = sorted(set(rng.normal(size=200).round(2))), sorted(set(rng.normal(size=40).round(2)))
    wanted = spark.createDataFrame([("g", float(x)) for x in w] + [("h", 1.0)], "k string, v double")
    offered = spark.createDataFrame([("g", float(x)) for x in o], "k string, v double")
    got = {(r.k, r.v): r.gap for r in joins.nearest_values(wanted, offered, ["k"], "v").collect()}
    assert got[("h", 1.0)] is None
    for x in w:
        assert got[("g", float(x))] == pytest.approx(min(abs(x - y) for y in o))


def test_recording_sets_zip_by_position(spark):
    rows = [(1, "a", 11), (1, "a", 12), (1, "o", 21), (1, "poem", 31), (1, "poem", 32), (1, "poem", 33), (2, "a", 41), (3, "x", 51)]
    df = spark.createDataFrame(rows, "audio_id int, recording_category string, recording_identifier long")
    got = joins.recording_sets(df, ["a", "o"], ["poem"], ["recording_identifier"]).orderBy("audio_id", "sample").collect()
    assert [(r.audio_id, r.acoustic_ids, r.embed_ids) for r in got] == [
        (1, [11, 21], [31]), (1, [], [32]), (1, [], [33]), (2, [], []), (3, [], []),
    ]


def test_parallel_lists_must_have_one_length(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, [], [])], "i int, a array<double>, b array<double>")
    assert reshape.explode_parallel(good, ["i"], ["a", "b"], ["x", "y"]).count() == 2
    bad = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "i int, a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal length"):
        reshape.explode_parallel(bad, ["i"], ["a", "b"], ["x", "y"]).collect()


def test_gather_keeps_the_order_and_reports_gaps(spark):
    vectors = spark.createDataFrame([(1, [1.0, 1.5]), (2, [2.0, 2.5])], "vid int, v array<double>")
    samples = spark.createDataFrame([("s", [2, 1]), ("t", [1, 9]), ("u", [])], "s string, ids array<int>")
    gather = lambda df: {r.s: r.out for r in joins.gather(df, "ids", vectors, "vid", "v", "s", "out").collect()}
    assert gather(samples.where("s != 't'")) == {"s": [2.0, 2.5, 1.0, 1.5], "u": []}
    with pytest.raises(Exception, match="no vector for vid 9"):
        gather(samples)
    assert [(r.s, r.vid) for r in joins.missing_ids(samples, "ids", vectors, "vid", "s").collect()] == [("t", 9)]


def test_original_sets_need_every_category(spark):
    rows = [(1, "a", "2025-01-02", 1), (1, "o", "2025-01-03", 2), (2, "a", "2025-01-04", 3)]
    table = spark.createDataFrame(rows, "audio_id int, recording_category string, date string, no int")
    sets = lambda df: joins.original_sets(table, df, ["a", "o"], ["date"]).collect()
    assert len(sets(table.where("audio_id = 1"))) == 2
    with pytest.raises(Exception, match="no recording o of 2"):
        sets(table)


def test_original_sets_query_keeps_persons_without_a_category(spark, tmp_path):
    from pairwell.catalog import REGISTRY
    from pairwell.catalog.base import Tables

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderpriority <> '1-URGENT' or o_custkey % 4 = 0")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = REGISTRY["original_recording_sets"].run(Tables(spark, str(tmp_path))).collect()
    assert {r.audio_id for r in got} == {r[0] for r in orders.where("o_custkey % 2 = 0").select("o_custkey").distinct().collect()}
    lost = {(r.audio_id, r.recording_category) for r in got if r.recording_identifier is None}
    assert lost and all(r.date is None for r in got if r.recording_identifier is None)


def test_file_names(spark, tmp_path):
    for name in ["12_a.wav", "12_poem_20250203.wav", "12_a_20251399.wav", "notes.txt", "12345_a.wav"]:
        (tmp_path / name).write_bytes(b"x")
    got = files.parse_names(files.list_files(spark, str(tmp_path))).orderBy("longitudinal").collect()
    assert [(r.audio_id, r.recording_category, r.date, r.longitudinal) for r in got] == [(12, "a", None, 0), (12, "poem", "2025-02-03", 1)]


def test_run_store_and_histories(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    for exp, run, status in [("e1", "r1", "3"), ("e1", "r2", "4"), ("e2", "r1", "1"), ("e2", "r3", "FINISHED")]:
        put(f"{exp}/{run}/meta.yaml", f"run_id: {run}\nstatus: {status}\nstart_time: 5\nend_time: null\n")
        put(f"{exp}/{run}/params/c", "lr\n")
    put("e1/r1/metrics/auroc_mean", "1 0.5 0\n2 0.75 1\n")
    put("e1/r1/metrics/auroc", "1 0.3 2\nbad\n1 0.1 0\n1 x 1\n")
    put("e2/r1/metrics/auroc", "1 0.9 0\n")
    put("e2/r1/metrics/auroc_mean", "1 0.9 0\n")
    store = runs.scan(spark, str(tmp_path))
    table = runs.run_table(store)
    got = {(r.experiment, r.run_id): (r.status, r["params.c"], r["metrics.auroc_mean"]) for r in table.collect()}
    assert got == {("e1", "r1"): ("FINISHED", "lr", 0.75), ("e2", "r1"): ("RUNNING", "lr", 0.9)}
    first = runs.first_experiment(runs.metric_history(store, ["auroc"]), ["e1", "e2"]).collect()
    assert [(r.run_id, r["values"]) for r in first] == [("r1", [0.1, 0.3])]


def test_empty_sheet_is_an_error(spark, tmp_path):
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "main"))
    with pytest.raises(contracts.ContractError):
        tables.read_sheet(spark, str(tmp_path), "main")


def test_raw_sheet_to_recordings(spark):
    raw = spark.createDataFrame(
        [
            ("V1", "1", "1950", "m", "COPD", "0", "0", "1"),
            ("V2", "2", "1960", "w", "keine bekannt", "1", "1", "1"),
            ("V3", "3", "1970", "w", "COPD", "1", "0", "1"),  # control with a disease
            ("V4", "4", "1980", "w", "asthma?", "0", "0", "1"),  # question mark
            ("V5", "5", "x", "w", "Asthma", "0", "0", "0"),  # not ready
        ],
        "`Studien - ID` string, `Audio-ID` string, Geburtsjahr string, Sex string, `Lungenerkrankung -Haupt` string, "
        "Controll string, longitudinal string, `Ready_to_Use` string",
    )
    main = metadata.clean_main(raw)
    assert [(r.audio_id, r.lung_disease_main) for r in main.orderBy("audio_id").collect()] == [(1, "copd"), (2, "control")]
    singles = metadata.single_dates(spark.createDataFrame([("V1", "03/02/2025")], "`Studien-ID` string, Datum string"), main)
    dates = metadata.longitudinal_dates(
        spark.createDataFrame(
            [("V2", "2", "05/03/2025", "01/03/2025", None)],
            "`Studien-ID` string, `Audio-ID` string, `Datum Stimmaufnahme 1` string, `Datum Stimmaufnahme 2` string, `Datum Stimmaufnahme 3` string",
        )
    )
    paths = [("/w/1_a.wav",), ("/w/1_poem.wav",), ("/w/2_a_20250301.wav",), ("/w/2_a_20250305.wav",)]
    catalogue = files.parse_names(spark.createDataFrame(paths, "path string"))
    table = metadata.recordings(main, singles, dates, catalogue)
    got = sorted((r.audio_id, r.recording_category, r.date, r.temporal_order) for r in table.collect())
    assert got == [(1, "a", "2025-02-03", None), (1, "poem", "2025-02-03", None), (2, "a", "2025-03-01", 1), (2, "a", "2025-03-05", 2)] or [
        g[:3] for g in got
    ] == [(1, "a", "2025-02-03"), (1, "poem", "2025-02-03"), (2, "a", "2025-03-01"), (2, "a", "2025-03-05")]
    durations = table.select("audio_sample_path", F.when(F.col("audio_id") == 1, 5.0).otherwise(2.0).alias("duration_sec"))
    empty = table.limit(0).withColumn("age", F.lit(1))
    merged = metadata.merge_sources(table, empty, durations)
    assert metadata.validate(merged.withColumns({"height_cm": F.lit(None).cast("double"), "weight_kg": F.lit(None).cast("double"),
        "chunk_start_sec": F.lit(None).cast("double"), "chunk_duration_sec": F.lit(None).cast("double")})).count() == 2


def test_flatten_json_of_any_depth(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":"x"}},"l":[{"m":1}]}},"bad":"{no object","k":"y"}'
    df = spark.createDataFrame([(1, deep), (2, '{"k":"z"}'), (3, None)], "id int, j string")
    got = sorted(tuple(r) for r in frames.flatten_json(df, "j", ["id"]).collect())
    assert got == [(1, "a.b.c.d.e", "x"), (1, "a.b.l", '[{"m":1}]'), (1, "bad", "{no object"), (1, "k", "y"), (2, "k", "z")]


def test_best_by_direction_ranks_all_rows(spark):
    rows = spark.range(1500).select(F.lit("a_to_b").alias("direction"), (F.col("id") / 1500).alias("weighted_auroc"), F.lit("s").alias("splitting"), F.col("id").alias("classifier"))
    got = tables.best_by_direction(rows)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 1501))
