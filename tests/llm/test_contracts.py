"""Every corpus query against its contract in plain Python, on the smallest tables and on a fixture of odd rows."""

import os
import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

from pairwell.llm import chat, decontamination, mixing, ngram_join, private, quality, sharding, substrings, urls, warc  # noqa: E402
from pairwell.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 1000}x{i}" for i in range(1500))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil tea for nobody"
ODD = [
    (1, LONG, "a"),
    (2, LONG, "a"),
    (3, LONG + " tail", "a"),
    (4, None, None),
    (5, "", "b"),
    (6, "one two", "b"),
    (7, "One TWO", "b"),
    (8, f"start {PASSAGE} end", "a"),
    (9, f"{PASSAGE}", None),
    (10, "x" * 120, "a"),
    (11, "y" + "x" * 130 + "é" * 60, "a"),
    (12, "mail me@x.org or 10.0.0.1 or 4111 1111 1111 1111 or +49 (30) 1234567 é", "c"),
    (13, " \n\t \x0b", "c"),
    (14, "same line here\n" * 40, "c"),
    (15, "a b c d e f g h i j " * 3, "c"),
    (16, "999.1.2.3.4 1.2.3.4.5.6.7.8 a@b@c.de 1..2 @x.y 12-34-56-78-90-12", "c"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, shard int, _h int, _row int, found int, position int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", 1, 7, 7, 7, 7, 7) for r in ODD], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["documents", "odd", "none"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_sharding(docs):
    got = sharding.interleave(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len((t or "").encode()) + 16) for d, t in pairs(docs))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) <= set(range(40)) and (not got or max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1)
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_quality(docs):
    got = quality.report(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(got, "doc_id", *names) == sorted(((d, *brute.quality(t)) for d, t in pairs(docs)), key=repr)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs(kept)) == Counter((d, t) for d, t in pairs(docs) if brute.quality(t)[-1])


def test_private_base_spans(docs):
    got = private.find_private(docs).collect()
    expected = {d: brute.private(t) for d, t in pairs(docs)}
    assert len(got) == len(expected)
    for r in got:
        base = expected[r["doc_id"]]
        told = [f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == brute.sha(",".join(told)), (r["doc_id"], told, r["spans"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(told) <= set(r["spans"].split(",")) or not told


def test_repeated_substrings(docs):
    got = substrings.remove_repeats(docs)
    assert rows_of(got.drop("kept")) == sorted(brute.repeats(pairs(docs)), key=repr)


def test_ngram_join(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()}
    expected = brute.classes(pairs(docs))
    assert got == expected
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(d for d, _ in pairs(kept)) == sorted(d for d, (_, c) in expected.items() if c == d)


def test_ngram_join_of_a_large_family(spark):
    """Copies with some changed words: few of their pairs are links, but these join nearly all."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(200):
        words = list(base)
        for i in draw.sample(range(150), draw.choice((1, 2, 2, 3, 3, 3, 4))):
            words[i] = f"c{d}x{i}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()}
    assert got == brute.classes(rows)
    assert 1 < len({c for _, c in got.values()}) < 150


def test_decontamination(docs, spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    items = [tuple(r) for r in items] + [(900, PASSAGE), (901, "One two"), (902, None), (903, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = list(brute.contamination(pairs(docs), items))
    assert rows_of(decontamination.report(docs, benchmark)) == sorted(expected, key=repr)
    clean = decontamination.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and sorted(d for d, _ in pairs(clean)) == sorted(r[0] for r in expected if not r[-1])


def test_mixing(docs):
    got = mixing.replicate(docs, epochs=2.0)
    rows = got.collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    count = Counter(r["doc_id"] for r in rows)
    assert all(count[r["doc_id"]] == r["repeats"] for r in rows)
    assert mixing.replicate(docs, weights={"nowhere": 1.0}).count() == 0


def test_mixing_rates(documents):
    sizes = {r[0]: r[1] for r in documents.groupBy("source").agg(F.sum(F.octet_length("text") + 16)).collect()}
    weights = {s: i + 1.0 for i, s in enumerate(sorted(sizes))}
    got = mixing.replicate(documents, weights=weights, epochs=200.0)
    mixed = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum(F.octet_length("text") + 16)).collect()}
    for s, w in weights.items():
        assert abs(mixed[s] / sum(mixed.values()) - w / sum(weights.values())) < 0.03


def test_urls(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    more = [(-1, None), (-2, ""), (-3, "no scheme.com/x"), (-4, "http://EXAMPLE.com/en/x?y"), (-5, "http://www.example.com/en/"), (-6, "a://b://c.net/es/q#"), (-7, "http://x.net"), (-8, "http://com/é\n?")]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string")).withColumn("host", F.lit(3))
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    for r in pages.collect():
        host, path, name, says = brute.rule(r["url"], urls.RULES)
        out = got[r["page_id"]]
        assert (out["host"], out["path"], out["rule"]) == (host, path, name)
        assert out["verdict"] == says if says else out["verdict"] in ("allow", "block")
    assert len(got) == pages.count() and urls.judge_urls(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    more = [(-1, None, None), (-2, "x", ""), (-3, "u\r\nv", "é\r\n\r\nz"), (-4, "é", "é\r\n\r\nz"), (-5, "l", LONG * 20)]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string, html string"))
    expected = brute.archives([(r["page_id"], r["html"]) for r in pages.collect()])
    assert rows_of(warc.archive_and_read(pages)) == sorted(expected, key=repr)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(-2, 0, "user", None), (-2, 1, "user", "\\<|im_end|>\n<|im_next|>\\n"), (-2, 1, "user", "\\\\n"), (-2, 3, "assistant", ""), (-3, 0, None, "<|"), (-3, 1, "a\n\\n", "|\\<\\|")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat.format_chats(frame)
    got = chat.chat_digests(formatted)
    assert rows_of(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(brute.chats(rows), key=repr)
    whole = {r["conv_id"]: r for r in formatted.collect()}
    for conv, r in whole.items():
        at, learned = 0, []
        for run in r["mask"]:
            learned += [r["formatted"][at : at + run["chars"]]] if run["loss"] else []
            at += run["chars"]
        assert at == len(r["formatted"])
        plain = "".join(learned).replace("\\|", "|").replace("\\\\", "\\")
        if conv != -3:
            assert len(plain) == next(x[3] for x in brute.chats([q for q in rows if q[0] == conv]))
    assert chat.chat_digests(chat.format_chats(frame.limit(0))).count() == 0


def test_repeated_rows_and_null_ids(spark, odd):
    """Rows with a NULL id or an id that others hold neither crash a job nor change the number of rows."""
    twice = odd.union(odd).union(odd.withColumn("doc_id", F.lit(None).cast("long")))
    n = twice.count()
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for made in (
        sharding.interleave(twice), quality.report(twice), private.find_private(twice), substrings.remove_repeats(twice),
        ngram_join.shingle_components(twice), decontamination.report(twice, benchmark),
    ):
        assert made.count() == n
    assert ngram_join.keep_one(twice).where("doc_id is not null").count() == ngram_join.keep_one(odd).count()
    same = rows_of(substrings.remove_repeats(twice).where("doc_id is not null").drop("kept"))
    assert same == sorted(rows_of(substrings.remove_repeats(odd).drop("kept")) * 2, key=repr)


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_sharding_moves_the_texts(documents, tmp_path):
    """Every column arrives in the shards, whose rows lie together in the written files."""
    got = sharding.interleave(documents)
    assert rows_of(got, *documents.columns) == rows_of(documents)
    assert "text" in corpus_pipeline.sharded_documents(documents.sparkSession, documents, FOLDER).columns
    corpus_pipeline.sharded_documents(documents.sparkSession, documents, FOLDER).write.parquet(str(tmp_path / "shards"))
    back = documents.sparkSession.read.parquet(str(tmp_path / "shards"))
    spans = back.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("shard", "slot")).alias("a"), F.max(F.struct("shard", "slot")).alias("b"))
    spans = sorted((tuple(r["a"]), tuple(r["b"])) for r in spans.collect())
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    told = QUERIES["op1_sharding"](documents.sparkSession, FOLDER)
    assert rows_of(told) == rows_of(got, *told.columns)


def test_copies_are_spread(spark, tmp_path):
    """The pipeline's mixture is written in its global order, and copies of a document go to different shards."""
    rows = [(d, f"text of document {d} " * 20, "b" if d % 10 else "a") for d in range(300)] + [(300, "one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Nearly all copies of "c" are of one document.
    expected = [r[0] for r in mixing.replicate(docs).orderBy("position").select("doc_id").collect()]
    corpus_pipeline.mixed_documents(spark, docs, FOLDER).coalesce(1).write.parquet(str(tmp_path / "mixed"))
    got = [r[0] for r in spark.read.parquet(str(tmp_path / "mixed")).select("doc_id").collect()]
    assert got == expected and len(got) > 250
    places = [i for i, d in enumerate(got) if d == 300]
    assert len(places) > 20 and max(places) - min(places) > len(got) // 2 and sum(b - a == 1 for a, b in zip(places, places[1:], strict=False)) < len(places) // 2
    copies = spark.range(50).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a copy").alias("text"), F.lit("a").alias("source"))
    more = spark.range(1000, 1750).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    shards = sharding.interleave(copies.union(more)).where("doc_id = 7").select("shard", "slot").collect()
    assert len({(r["shard"], r["slot"]) for r in shards}) == 50 and len({r["shard"] for r in shards}) > 20
