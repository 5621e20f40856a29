"""Whole-frame cleaning steps."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import expressions as E
from pairwell.functions import vocabulary as V
from pairwell.operators.scan import column_medians, exact_percentiles


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_names(df: DataFrame, inner_spaces: bool = True) -> DataFrame:
    """Lower-case headers without whitespace (or only trimmed, if ``inner_spaces`` is False)."""
    if inner_spaces:
        return df.toDF(*[re.sub(r"\s+", "", c).lower() for c in df.columns])
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def null_tokens(df: DataFrame, tokens: Sequence[str] = V.RAW_NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: E.null_tokens(F.col(c), tokens) for c in text_columns(df)})


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: E.to_number(F.col(c)) for c in columns if c in df.columns})


def trim_lower(df: DataFrame) -> DataFrame:
    return df.withColumns({c: E.trim_lower(F.col(c)) for c in text_columns(df)})


def standard_terms(df: DataFrame, columns: Sequence[str], mapping: Mapping[str, str] = V.DISEASE_TERMS) -> DataFrame:
    return df.withColumns({c: E.standard_term(F.col(c), mapping) for c in columns if c in df.columns})


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the named constants where a column is absent."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def one_hot(
    df: DataFrame, column: str, separator: str = ",", tokens: Sequence[str] | None = None, limit: int = 1000
) -> DataFrame:
    """One 0/1 column per token of a delimited text.

    Without a token list the distinct tokens are read first; more than ``limit`` is an error, since
    a wide frame of that size is never what is wanted.
    """
    listed = F.split(F.coalesce(F.col(column), F.lit("")), re.escape(separator))
    if tokens is None:
        found = df.select(F.explode(listed).alias("t")).where("t <> ''").distinct().orderBy("t").limit(limit + 1)
        tokens = [r.t for r in found.collect()]
        if len(tokens) > limit:
            raise ValueError(f"more than {limit} tokens in {column}")
    return df.withColumns({t: F.array_contains(listed, t).cast("int") for t in tokens})


def fill_missing(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    """Median for continuous columns (0 if there is none), 0 for the others."""
    medians = column_medians(df, continuous) if continuous else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c] or 0.0)) for c in continuous}
    filled |= {c: F.coalesce(E.to_number(F.col(c)), F.lit(0.0)) for c in discrete}
    return df.withColumns(filled)


def fill_ages_from_ranges(df: DataFrame, source: str, out: str) -> DataFrame:
    """Parse age ranges, then fill the gaps with the overall median (whole part)."""
    parsed = df.withColumn(out, E.age_from_range(F.col(source)))
    median = exact_percentiles(parsed, out, {"m": 0.5}).select("m").scalar()
    return parsed.withColumn(out, F.coalesce(F.col(out), median.cast("int")))


def standardize(df: DataFrame, column: str, out: str, squared: str | None = None) -> DataFrame:
    """``(x - mean) / (population sd + 1e-9)`` and, if named, its square."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    m, s = stats.select("m").scalar(), stats.select("s").scalar()
    scaled = df.withColumn(out, (F.col(column) - m) / (s + F.lit(1e-9)))
    return scaled if squared is None else scaled.withColumn(squared, F.col(out) * F.col(out))


def repaired_logit(df: DataFrame, column: str, out: str) -> DataFrame:
    """Logit, with non-finite values replaced by the median of the finite ones."""
    with_logit = df.withColumn(out, E.logit(F.col(column)))
    gap = with_logit.where(F.col(out).isNull()).limit(1).count() > 0
    if not gap:
        return with_logit
    median = exact_percentiles(with_logit, out, {"m": 0.5}).select("m").scalar()
    return with_logit.withColumn(out, F.coalesce(F.col(out), median))


def strip_prefixes(df: DataFrame, prefixes: Sequence[str] = ("params.", "metrics.")) -> DataFrame:
    """Drop a header prefix wherever the bare name is free."""
    bare = set(df.columns)
    renames: dict[str, str] = {}
    for prefix in prefixes:
        for c in df.columns:
            short = c.replace(prefix, "")
            if c.startswith(prefix) and short not in bare and short not in renames.values():
                renames[c] = short
    return df.toDF(*[renames.get(c, c) for c in df.columns])


def flatten_json(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """JSON objects of any depth to rows of dotted key and text value; lists and malformed objects stay as text."""
    entries = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    level = df.select(*keys, F.explode(entries(F.col(column))).alias("e")).select(
        *keys, F.col("e.key").alias("key"), F.col("e.value").alias("value")
    )
    nested = F.when(F.col("value").startswith("{"), entries(F.col("value")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("value").alias("value")))
    # Each round removes the outermost braces, so it ends with the deepest object.
    while not level.where(nested.isNotNull()).isEmpty():
        level = level.select(*keys, "key", F.explode(F.coalesce(nested, own)).alias("e")).select(
            *keys, F.concat_ws(".", "key", "e.key").alias("key"), F.col("e.value").alias("value")
        )
    return level


def contract_columns(
    df: DataFrame, label: str, source: str, category: str, birth_year_origin: int = V.CROWD_REFERENCE_YEAR
) -> DataFrame:
    """Columns a matched table needs before it can serve as a recording table."""
    out = df.withColumns(
        {
            "lung_disease_main": F.when(F.col(label) == 1, "copd").when(F.col(label) == 0, "control"),
            "data_source": F.lit(source),
            "recording_category": F.lit(category),
            "longitudinal": F.lit(0),
            "temporal_order": F.lit(1.0),
        }
    )
    extra = {}
    if "birth_year" not in df.columns:
        extra["birth_year"] = (F.lit(birth_year_origin) - F.col("age")).cast("int")
    if "control" not in df.columns:
        extra["control"] = (F.col(label) == 0).cast("int")
    if "study_id" not in df.columns and "uid" in df.columns:
        extra["study_id"] = F.col("uid")
    out = out.withColumns(extra)
    return out.drop("stratum", "age_z", "age_z2", "ps", "logit_ps", label)


def feature_names(spark, blocks: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Catalogue of feature names in matrix order.

    A block is (name, base names, recordings). With several recordings every base name is repeated
    per recording and carries its name as a suffix.
    """
    rows = []
    for block, base, recordings in blocks:
        names = base if len(recordings) <= 1 else [f"{b}_{r}" for r in recordings for b in base]
        rows += [(block, n) for n in names]
    return spark.createDataFrame([(b, n, i) for i, (b, n) in enumerate(rows)], "block string, name string, pos long")
