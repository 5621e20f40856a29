"""Spelling variants against a comparison of all words with all edits."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pairwell.llm import variants
from pairwell.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(variants.UPPER, variants.LOWER)
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def words(rows):
    count = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def report(rows):
    count = words(rows)
    near = defaultdict(set)
    holes = defaultdict(list)
    for w in count:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in count:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= 10 * n:
            form[w] = best
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None


def told(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def same(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, n int, word string, cell double").repartition(parts)
    got = told(variants.spelling_variants(docs))
    assert got == sorted(report(rows))
    return got


def test_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = told(QUERIES["op13_spelling_variants"](spark, FOLDER))
    assert got == sorted(report(rows)) and len(got) > 50


def family(seed, size):
    """Texts of few long words with many edits, of letters in few counts."""
    draw = random.Random(seed)
    base = ["aabbccddee", "étranger", "straÿbergen", "zzzzzzzzzz", "Ünderstand", "abcdefgh"]
    rows = []
    for d in range(size):
        out = []
        for w in draw.choices(base, k=40):
            for _ in range(draw.choice((0, 0, 0, 1, 1, 2))):
                i = draw.randrange(len(w))
                w = draw.choice((w[:i] + w[i + 1 :], w[:i] + draw.choice("abezéÿ") + w[i:], w[:i] + draw.choice("abcdéÿ") + w[i + 1 :]))
            out.append(w)
        rows.append((d if d % 9 else None, draw.choice((" ", "-", "9")).join(out)))
    return rows


def test_edits_and_chains(spark):
    draws = ["abcdefgh"] * 300 + ["abcdefghi"] * 25 + ["abcdefghij"] * 2
    rows = family(1, 120) + [(500 + i, w) for i, w in enumerate(draws)] + [(900, None), (901, ""), (902, "short words only")]
    got = same(spark, rows + rows[:40])
    assert any(r[1] not in (None, r[2]) for r in got)


@pytest.mark.parametrize("cell_bytes", [200, 4_000_000])
def test_small_cells(spark, monkeypatch, cell_bytes):
    """Many cells and parts of cells."""
    monkeypatch.setattr(variants, "CELL_WORDS", 16)
    monkeypatch.setattr(variants, "CELL_BYTES", cell_bytes)
    same(spark, family(2, 150))


def test_small_sample(spark, monkeypatch):
    """The sample sets the cells, not the result: lengths that it lacks have a cell, too."""
    monkeypatch.setattr(variants, "SAMPLE_WORDS", 60)
    monkeypatch.setattr(variants, "CELL_WORDS", 64)
    same(spark, family(3, 150))


def test_anagrams_and_long_words(spark):
    draw = random.Random(4)
    shuffled = ["".join(draw.sample("abcdefghi", 9)) for _ in range(400)]
    long = "abc" * 800
    rows = [(1, " ".join(shuffled * 2)), (2, " ".join([long, long + "d", long[:-1] + "x"] * 30)), (3, long + "d")]
    same(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(docs).count() == 0
