"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from distinct URLs that the rules decide, a bounded number for each label, weighted so that the labels
have the shares that they have among all of these URLs. Features: lengths, depths, digit share, entropy of the
characters, parameters, and statistics of the host's suffix counted over all URLs.

Defined cases: NULL urls and urls without ``://`` have an empty host and path, fit no rule and are judged by the
trees; equal rows are judged alike; without labelled URLs, or with one label only in all rows, that label (allow
if none) holds for all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import join_facts
from pairwell.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: At most so many distinct URLs of each label, those with the smallest hashes, train the trees.
TRAINING_ROWS = 8000
FEATURES = ("url_length", "host_length", "host_depth", "path_length", "path_depth", "digit_share", "entropy", "parameters", "suffix_rows", "suffix_blocked")


def split_url(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none fits."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name, says = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(says)
    return name, says


def count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of ``_url`` with its ``host`` and ``path``."""
    url = F.col("_url")
    n = F.length(url)
    kinds = F.array_distinct(F.split(url, ""))
    share = lambda c: F.length(url) - F.length(F.replace(url, c, F.lit("")))
    bits = F.aggregate(
        F.transform(F.filter(kinds, lambda c: c != ""), share),
        F.lit(0.0),
        lambda a, k: a - k / n * F.log2(k / n),
    )
    return rows.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_depth": count_of(F.col("host"), ".").cast("double"),
            "path_length": F.length("path").cast("double"),
            "path_depth": count_of(F.col("path"), "/").cast("double"),
            "digit_share": F.coalesce(count_of(url, "0123456789") / F.greatest(n, F.lit(1)), F.lit(0.0)).cast("double"),
            "entropy": F.coalesce(bits, F.lit(0.0)).cast("double"),
            "parameters": count_of(url, "?&=").cast("double"),
        }
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"), host.alias("host"), path.alias("path"))
    name, says = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_says": says, "_suffix": F.substring_index("host", ".", -1)})
    # Counts over all URLs. The share of blocked ones is smoothed towards one half.
    blocked = F.sum((F.col("_says") == "block").cast("int"))
    suffixes = rows.groupBy("_suffix").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.log1p(F.count(F.lit(1)).cast("double")).alias("suffix_rows"),
        ((F.coalesce(blocked, F.lit(0)) + 1.0) / (F.count("_says") + 2.0)).alias("suffix_blocked"),
    )
    known = lexical(join_facts(rows, suffixes, "_suffix", "page_id"))
    distinct = rows.where(F.col("_says").isNotNull()).select("_url", "host", "path", "_suffix", "_says").distinct()
    labels = {r["_says"]: r["n"] for r in distinct.groupBy("_says").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = ("page_id", "host", "path", "rule")
    if len(labels) < 2:
        return known.select(*columns, F.coalesce("_says", F.lit("block" if "block" in labels else "allow")).alias("verdict"))
    sample = None
    for says, n in sorted(labels.items()):
        part = distinct.where(F.col("_says") == says).orderBy(F.xxhash64("_url"), "_url").limit(training_rows)
        part = part.withColumn("weight", F.lit(n / min(n, training_rows)))
        sample = part if sample is None else sample.union(part)
    sample = lexical(durable(sample).join(suffixes.drop("_rows"), "_suffix"))
    sample = durable(sample.orderBy("_url").select((F.col("_says") == "block").cast("double").alias("label"), "weight", *FEATURES))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.3, seed=5)
    model = trees.fit(assembler.transform(sample.coalesce(1)))
    judged = model.transform(assembler.transform(known.select(*columns, "_says", *FEATURES)))
    found = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*columns, F.coalesce("_says", found).alias("verdict"))
