"""Near copies whose ids are shared or NULL: one row of each component stays, and no other document is lost."""

from pairwell.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))


def test_verdicts_are_by_row(spark):
    rows = [
        (1, LONG, "x"), (2, LONG + " tail", "x"), (2, OTHER, "unique"),  # an id held by a copy and by a clean document
        *[(None, f"{THIRD} end{i % 3}", "near") for i in range(40)],  # NULL ids only: one of them stays
        (None, LONG, "x"), (7, "just three words", "x"), (7, "just three words", "x"), (8, "", "x"), (9, None, "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert sorted((r for r in got if r[0] is not None), key=lambda r: (r[0], r[1] or "")) == [
        (1, LONG, "x"), (2, OTHER, "unique"), (7, "just three words", "x"), (8, "", "x"), (9, None, "x"),
    ]
    assert len([r for r in got if r[0] is None]) == 1 and got[[r[0] for r in got].index(None)][2] == "near"
