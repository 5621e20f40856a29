"""The cascade computes facts only where they are needed, and its sample stays bounded."""

from pairwell.llm import quality


def docs_of(spark):
    good = [(i, f"text number {i} tells of a day in the hills and of the long way home", i) for i in range(40)]
    copies = [(100 + i, "few words", i) for i in range(400)]
    junk = [(600, "## $$ %% " * 20, 0), (601, "!" * 200 + " a b c d e f g h i j k", 0), (602, None, 0), (603, "one and the same line of words\n" * 9, 0)]
    return spark.createDataFrame(good + copies + junk, "doc_id long, text string, `a.b` int")


def test_kept_rows_do_not_depend_on_the_order(spark):
    docs = docs_of(spark)
    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        kept = quality.keep_good(docs, rules)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_facts_known_before_are_not_computed_again(spark):
    rows = docs_of(spark).selectExpr("doc_id as _row", "text as _text")
    all_facts = {r["_row"]: r["t"] for r in quality.with_facts(rows, "t").collect()}
    step, known = rows, []
    for names in (("n_words",), ("n_lines", "n_dup_lines"), ("n_words", "n_repeat_words"), ("word_chars", "n_symbols")):
        step = quality.with_facts(step, "t", names, known)
        known = [f for f in step.schema["t"].dataType.names if f != "text"]
    for r in step.collect():
        assert all(r["t"][n] == all_facts[r["_row"]][n] for n in quality.FACTS)
    assert step._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_sample_is_bounded_and_not_made_of_copies_alone(spark):
    docs = docs_of(spark)
    texts = [r["_text"] for r in quality.sampled(docs, 100, "text").collect()]
    assert 50 <= len(texts) <= 100
    assert any(t == "few words" for t in texts) and any((t or "").startswith("text number") for t in texts)
    assert quality.sampled(docs, 10_000, "text").count() == docs.count()
    assert quality.sampled(docs.limit(0), 10, "text").count() == 0


def test_own_rule_sees_all_facts(spark):
    rule = quality.Rule("symbols", lambda t: 2 * t["n_symbols"] > t["word_chars"])
    kept = quality.keep_good(docs_of(spark), (rule,))
    assert 600 not in {r["doc_id"] for r in kept.collect()} and kept.count() == 443
