import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwell.operators import contracts, sampling


def rows(spark, persons=11, minority=3):
    data = [(p, i, int(p < minority)) for p in range(persons) for i in range(1 + p % 4)]
    return spark.createDataFrame(data, "person int, rec int, label int")


def test_rows_of_a_person_share_a_fold(spark):
    got = sampling.grouped_folds(rows(spark, 40, 12), "person", ["label"], 5).toPandas()
    assert (got.groupby("person").fold.nunique() == 1).all()
    per = got.drop_duplicates("person").groupby(["label", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()


def test_rare_class_falls_back_to_plain_folds(spark):
    got = sampling.grouped_folds(rows(spark), "person", ["label"], 5).toPandas().drop_duplicates("person")
    sizes = got.groupby("fold").size()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1


def test_too_few_persons_is_an_error(spark):
    with pytest.raises(contracts.ContractError):
        sampling.grouped_folds(rows(spark, 3), "person", ["label"], 5)


def test_repeats_use_different_folds_and_no_one_leaks(spark):
    got = sampling.repeated_folds(rows(spark, 60, 30), "person", ["label"], 5, 2)
    pdf = got.toPandas()
    assert set(pdf[pdf.repeat == 0].fold) == {1, 2, 3, 4, 5} and set(pdf[pdf.repeat == 1].fold) == {6, 7, 8, 9, 10}
    wide = pdf.pivot(index="person", columns="repeat", values="fold")
    assert (wide[1] - 5 != wide[0]).any()
    placed = got.crossJoin(spark.range(1, 11).withColumnRenamed("id", "test")).where("floor((fold-1)/5) = floor((test-1)/5)")
    marked = placed.withColumn("part", F.when(F.col("fold") == F.col("test"), "test").otherwise("train"))
    assert contracts.leaks(marked, "test", "person", "part").isEmpty()


def test_multiplicities_add_up_to_the_class_size(spark):
    persons = spark.range(30).select(F.col("id").alias("person"), (F.col("id") < 8).cast("int").alias("label"))
    drawn = sampling.bootstrap(persons, "person", 25, ["label"]).join(persons, "person").toPandas()
    sums = drawn.groupby(["b", "label"]).m.sum().unstack()
    assert (sums[1] == 8).all() and (sums[0] == 22).all()
    assert drawn.groupby("person").size().gt(0).all()


def test_bootstrap_auroc_matches_repeated_rows(spark):
    pdf = pd.DataFrame({"person": range(12), "y": [0, 1] * 6, "p": [0.1, 0.4, 0.35, 0.8, 0.2, 0.7, 0.5, 0.5, 0.6, 0.3, 0.1, 0.9]})
    df = spark.createDataFrame(pdf)
    got = {r.b: r.p for r in sampling.bootstrap_auroc(df, "person", "y", ["p"], None, 10).collect()}
    drawn = sampling.bootstrap(df, "person", 10, ["y"]).toPandas().merge(pdf, on="person")
    for b, g in drawn.groupby("b"):
        g = g.loc[g.index.repeat(g.m)]
        pos, neg = g[g.y == 1].p.values, g[g.y == 0].p.values
        win = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
        assert got[b] == pytest.approx(win / (len(pos) * len(neg)))


def test_holdouts_draw_without_replacement(spark):
    units = spark.range(20).select(F.col("id").alias("u"), (F.col("id") % 2).alias("s"))
    got = sampling.holdouts(units, "u", ["s"], 3, 7).toPandas()
    assert (got.groupby(["b", "s"]).size() == 3).all() and not got.duplicated(["b", "u"]).any()


def plan(spark, seconds, length=6.0, overlap=0.0):
    df = spark.createDataFrame([(1, int(seconds * 1000))], "id int, ms long")
    out = sampling.chunk_plan(df, ["id"], "ms", int(length * 1000), int(overlap * 1000)).orderBy("chunk_number").collect()
    return [(r.chunk_start_sec, r.chunk_duration_sec) for r in out]


@pytest.mark.parametrize(
    "seconds,expected",
    [
        (4, [(0, 4)]),
        (6, [(0, 6)]),
        (8, [(0, 8)]),
        (9, [(0, 6), (6, 3)]),
        (15, [(0, 6), (6, 6), (12, 3)]),
        (20.5, [(0, 6), (6, 6), (12, 8.5)]),
    ],
)
def test_chunk_tail_rule(spark, seconds, expected):
    assert plan(spark, seconds) == expected


def test_overlap_must_be_shorter_than_a_chunk(spark):
    with pytest.raises(ValueError):
        plan(spark, 10, 6, 6)


def test_appended_chunks_inherit_and_are_unique(spark):
    base = spark.createDataFrame(
        [(1, "poem", "2025-01-02", "x", 11), (1, "a", "2025-01-02", "y", 12), (1, "poem", "2025-01-02", "z", 13)],
        "audio_id int, recording_category string, date string, audio_sample_path string, rec int",
    )
    chunks = spark.createDataFrame(
        [(1, 1, 0.0, 6.0, "c1"), (1, 2, 6.0, 6.0, "c2"), (1, 2, 6.0, 6.0, "c2"), (9, 1, 0.0, 4.0, "c9")],
        "audio_id int, chunk_number int, chunk_start_sec double, chunk_duration_sec double, audio_sample_path string",
    )
    got = sampling.append_chunks(base, chunks, ["rec"]).toPandas()
    assert sorted(got.audio_sample_path) == ["c1", "c2", "c9", "x", "y"]
    assert got[got.audio_sample_path == "c9"].date.item() == "1900-01-01"
    assert set(got[got.is_chunked].recording_category) == {"poem"}


def test_resamples_move_blocks_and_not_draws(spark):
    from pairwell.operators.resampling import BLOCK, Resamples

    n = BLOCK + 500
    persons = spark.range(n).select(
        F.col("id").alias("person"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 7 % 40).cast("double").alias("p"),
        (1 + F.col("id") % 5).cast("double").alias("w"),
    )
    drawn = Resamples(persons, "person", 3).store()
    assert drawn.draws().count() == 3 * 2
    pdf = drawn.rows().toPandas().merge(persons.toPandas(), on="person")
    assert (pdf.groupby("b").m.sum() == n).all()
    areas = {r.b: r for r in drawn.aurocs("y", {"plain": ("p", None), "weighted": ("p", "w")}).collect()}
    sums = {r.b: r.s for r in drawn.sums({"s": F.col("w") * F.col("y")}).collect()}
    for b, g in pdf.groupby("b"):
        assert sums[b] == pytest.approx((g.m * g.w * g.y).sum())
        for name, load in (("plain", g.m), ("weighted", g.m * g.w)):
            mass = g.assign(wp=load * g.y, wn=load * (1 - g.y)).groupby("p")[["wp", "wn"]].sum().sort_index()
            won = (mass.wp * (mass.wn.cumsum() - mass.wn / 2)).sum()
            assert areas[b][name] == pytest.approx(won / (mass.wp.sum() * mass.wn.sum()))


@pytest.mark.parametrize("spare", [40, -11])
def test_holdouts_take_the_lowest_hashes_of_large_strata(spark, monkeypatch, spare):
    import hashlib

    monkeypatch.setattr(sampling, "SPARE", spare)
    units = spark.range(400).select(F.col("id").alias("u"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    got = {(r.b, r.s, r.u) for r in sampling.holdouts(units, "u", ["s"], 3, 6).collect()}
    expected = set()
    for b in range(1, 7):
        for s in (None, 1, 2):
            mine = [u for u in range(400) if u % 3 == (s or 0)]
            expected |= {(b, s, u) for u in sorted(mine, key=lambda u: hashlib.md5(f"42|{b}|{u}".encode()).hexdigest()[:15])[:3]}
    assert got == expected


def test_draws_are_not_broadcast(spark):
    """They are made from a few short rows, by whose size the plan took them for a small table."""
    persons = spark.range(3000).select(F.col("id").alias("person"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = sampling.bootstrap(persons, "person", 4, ["y"])
    sums = {}
    for r in out.collect():
        sums[r.b] = sums.get(r.b, 0) + r.m
    assert sums == {b: 3000 for b in range(1, 5)}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
