"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a condition that rejects a text. On a bounded sample each rule's rejection rate and run time are
measured; rules with the most rejections per second go first. ``keep_good`` is a chain of filters in that order: the
facts of a rule are computed only for texts that no earlier rule rejected. ``report`` tells all facts of all texts, so
there the order only decides which conditions are compared. The order never changes the set of kept documents.

Word windows are compared by 64-bit hashes. Only texts that repeat a window at all go on to the step that finds
which words are covered.

Defined cases: NULL and empty texts have no words and fail the word minimum; equal rows get equal verdicts; an
empty table gives no rows and keeps the rules in their given order; columns of the input may have any names, since
the rules work on a struct beside the packed input row; very long texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.session import durable

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 1000
FACTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the facts of a text (see ``with_facts``) and says whether the text is rejected."""

    name: str
    rejects: Callable[[Column], Column]
    #: The facts that the condition reads, besides the text; what is not named is not there.
    needs: tuple[str, ...] = FACTS


BASE_RULES = (
    Rule("few_words", lambda t: t["n_words"] < 10, ("n_words",)),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 20 * t["n_words"], ("n_words", "n_repeat_words")),
)
MORE_RULES = (
    Rule("symbols", lambda t: without(t["text"], SYMBOLS) > 2 * t["n_words"], ("n_words",)),
    Rule("repeated_lines", lambda t: 10 * t["n_dup_lines"] > 3 * t["n_lines"], ("n_lines", "n_dup_lines")),
    Rule("shouting", lambda t: without(t["text"], "!") > t["n_words"], ("n_words",)),
    Rule("long_words", lambda t: t["word_chars"] > 50 * t["n_words"], ("n_words", "word_chars")),
)
RULES = BASE_RULES + MORE_RULES


def without(text: Column, letters: str) -> Column:
    """How many characters of a text are among ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def with_facts(rows: DataFrame, out: str, names: Sequence[str] = FACTS, known: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: a struct of the facts ``names``, and of those ``known`` ones that it has already.

    ``rows`` has the columns ``_row`` (anything), ``_text`` and, with known facts, ``out``. Hashes of the words are kept
    as a fact, so that words are extracted once. The steps stand in columns of their own, so that none is evaluated once
    for each element of another.
    """
    missing = [n for n in names if n not in known]
    hashed_words = {"n_words", "n_repeat_words"} & set(missing)
    step = rows.withColumn("_text", F.coalesce(F.col("_text"), F.lit("")))
    text = F.col("_text")
    facts = {n: F.col(out)[n] for n in known}
    if hashed_words and "hashes" not in known:
        step = step.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        step = step.withColumn("_n", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
        facts["hashes"] = F.col("_h")
        facts["n_words"] = F.col("_n")
    elif hashed_words:
        step = step.withColumn("_h", F.col(out)["hashes"]).withColumn("_n", F.size("_h").cast("long"))
        facts["n_words"] = F.col("_n")
    if {"n_lines", "n_dup_lines"} & set(missing):
        step = step.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        facts["n_lines"] = F.size("_lines").cast("long")
        facts["n_dup_lines"] = F.size("_lines").cast("long") - F.size(F.array_distinct("_lines"))
    if "n_repeat_words" in missing:
        step, facts["n_repeat_words"] = with_covered(step)
    if "word_chars" in missing:
        facts["word_chars"] = F.length(F.translate("_text", SPACES, "")).cast("long")
    if "n_symbols" in missing:
        facts["n_symbols"] = without(text, SYMBOLS).cast("long")
    flat = step.select("_row", "_text", *[v.alias(f"_f_{k}") for k, v in facts.items()])
    # A generator keeps the optimizer from copying the facts into every condition on them.
    return flat.select("_row", "_text", F.explode(F.array(F.struct(F.col("_text").alias("text"), *[F.col(f"_f_{k}").alias(k) for k in facts]))).alias(out))


def with_covered(step: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the places of repeated windows among the words ``_h``, and how many words such windows cover."""
    h = F.col("_h")
    hashed = lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4])
    step = step.withColumn("_w", F.when(F.col("_n") >= WINDOW, F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), hashed)))
    repeats = F.size(F.array_distinct("_w")) < F.size("_w")
    placed = F.transform("_w", lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    step = step.withColumn("_sorted", F.when(repeats, F.array_sort(placed)))
    s = F.col("_sorted")
    same = lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"])
    step = step.withColumn("_found", F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))))
    covered = F.aggregate(
        F.array_sort(F.transform("_found", lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )
    return step, F.coalesce(covered, F.lit(0)).cast("long")


def sampled(docs: DataFrame, sample_rows: int, text: str) -> DataFrame:
    """At most ``sample_rows`` texts: rows whose hash is below a limit set by the number of rows, the smallest first.

    About twice as many rows pass the limit as are wanted, so no task gathers more. Columns that tell copies of a text
    apart go into the hash, so a group of copies is not taken or left as a whole.
    """
    plain = [f.name for f in docs.schema.fields if f.name != text and not hasattr(f.dataType, "fields") and f.dataType.typeName() not in ("map", "array", "variant")]
    hashed = docs.select(F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_text"))
    share = min(1.0, 2 * sample_rows / max(docs.count(), 1))
    limit = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    return hashed.where(F.col("_hash") <= F.lit(limit)).orderBy("_hash", F.octet_length("_text")).limit(sample_rows).select(F.lit(0).alias("_row"), "_text")


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """Rules by measured rejections per second on at most ``sample_rows`` documents, chosen by a hash."""
    sample = durable(sampled(docs, sample_rows, text))

    def timed(rule: Rule | None) -> tuple[float, int, int]:
        # Only the facts that the rule needs are computed.
        facts = with_facts(sample, "t", rule.needs if rule else ())
        condition = F.coalesce(rule.rejects(F.col("t")), F.lit(False)) if rule else F.lit(False)
        start = time.perf_counter()
        row = facts.agg(F.count(F.lit(1)), F.sum(condition.cast("int"))).first()
        return time.perf_counter() - start, int(row[0]), int(row[1] or 0)

    idle = min(timed(None)[0] for _ in range(2))
    found = []
    for at, rule in enumerate(rules):
        seconds, rows, rejected = timed(rule)
        found.append((rejected / max(rows, 1) / max(seconds - idle, 1e-3), -at, rule))
    return [rule for *_, rule in sorted(found, key=lambda x: x[:2], reverse=True)]


def first_reason(rules: Sequence[Rule], facts: Column) -> Column:
    """Name of the first rule that rejects, NULL if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(facts), F.lit(rule.name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Each rule filters the rows before the facts of the next one are computed.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    for rule in ordered_rules(docs, rules, text=text):
        known = [f.name for f in rows.schema["_facts"].dataType.fields if f.name != "text"] if "_facts" in rows.columns else []
        if not known or set(rule.needs) - set(known):
            rows = with_facts(rows, "_facts", rule.needs, known)
        rows = rows.where(~F.coalesce(rule.rejects(F.col("_facts")), F.lit(False)))
    return rows.select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the facts, the base verdict and the cascade's verdict."""
    order = ordered_rules(docs, MORE_RULES)
    packed = docs.select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    facts = with_facts(packed, "t")
    t = F.col("t")
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.rejects(t)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = facts.select(F.col("_row").alias("doc_id"), *[t[n].alias(n) for n in names], failed.alias("base_failed"), t.alias("_t"))
    kept = F.when(F.col("base_failed"), False).otherwise(first_reason(order, F.col("_t")).isNull())
    return out.select("doc_id", *names, "base_failed", kept.alias("kept"))
