"""Eligibility filters, deduplication and attrition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.operators.contracts import ContractError


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in an explicit order (NULLs last for plain names).

    ``row_number`` with a limit is cut down on the map side before the shuffle, so a hot key sends
    only one row per input partition.
    """
    if not order:
        raise ValueError("an explicit order is needed to say which row is first")
    columns = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*columns)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: Sequence[str], by: str, tie: Sequence[str] = ()) -> DataFrame:
    return keep_first(df, keys, [F.col(by).desc_nulls_last(), *tie])


def best_version(df: DataFrame, keys: Sequence[str], metric: str, time: str, tie: Sequence[str] = ()) -> DataFrame:
    """One run per configuration: with the primary metric if possible, then the newest."""
    return keep_first(df, keys, [F.col(metric).isNull().asc(), F.col(time).desc_nulls_last(), *tie])


def ready_only(df: DataFrame, flag: str = "ready_to_use") -> DataFrame:
    return df.where(F.col(flag) == 1) if flag in df.columns else df


def unready_contradictions(df: DataFrame, flag="ready_to_use", control="control", disease="lung_disease_main"):
    """Clear the ready flag where the control flag contradicts the disease."""
    if not {control, disease} <= set(df.columns) or flag not in df.columns:
        return df
    healthy = F.col(disease).eqNullSafe("control")
    wrong = ((F.col(control) == 1) & ~healthy) | ((F.col(control) == 0) & healthy)
    return df.withColumn(flag, F.when(F.coalesce(wrong, F.lit(False)), 0).otherwise(F.col(flag)))


def unready_questions(df: DataFrame, columns: Sequence[str], flag: str = "ready_to_use") -> DataFrame:
    """Clear the ready flag where a critical column contains a question mark."""
    marks = [F.coalesce(F.col(c).cast("string").contains("?"), F.lit(False)) for c in columns if c in df.columns]
    if not marks or flag not in df.columns:
        return df
    return df.withColumn(flag, F.when(reduce(lambda a, b: a | b, marks), 0).otherwise(F.col(flag)))


def in_range(df: DataFrame, column: str, low: float, high: float, required: Sequence[str] = ()) -> DataFrame:
    kept = df.where(F.col(column).between(low, high))
    return kept.na.drop(subset=list(required)) if required else kept


def cascade(df: DataFrame, steps: Mapping[str, Column], person: str) -> DataFrame:
    """Attrition of a chain of criteria in one pass: rows and persons before and after each step."""
    passed = F.lit(True)
    aggregates, names = [], ["start", *steps]
    conditions = [passed]
    for condition in steps.values():
        passed = passed & F.coalesce(condition, F.lit(False))
        conditions.append(passed)
    for i, c in enumerate(conditions):
        aggregates += [F.count_if(c).alias(f"r{i}"), F.countDistinct(F.when(c, F.col(person))).alias(f"p{i}")]
    row = df.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(names[i]).alias("operation"),
            F.col(f"r{max(i - 1, 0)}").alias("rows_before"),
            F.col(f"r{i}").alias("rows_after"),
            (F.col(f"r{max(i - 1, 0)}") - F.col(f"r{i}")).alias("rows_removed"),
            F.col(f"p{i}").alias("persons_after"),
        )
        for i in range(len(names))
    ]
    return row.select(F.explode(F.array(*entries)).alias("s")).select("s.*")


def eligible(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, steps.values()))


def voice_files(df: DataFrame, path: str, catalogue: DataFrame, catalogue_path: str = "path") -> DataFrame:
    """Rows whose file name starts with ``voice_`` and whose file is in the catalogue."""
    named = df.where(F.element_at(F.split(F.col(path), "/"), -1).startswith("voice_"))
    return named.join(catalogue.select(F.col(catalogue_path).alias(path)), path, "left_semi")


def duration_gate(df: DataFrame, durations: DataFrame, path: str, minimum: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with a reason) by the measured duration of the file."""
    joined = df.join(durations.select(path, "duration_sec", F.lit(True).alias("_known")), path, "left")
    reason = (
        F.when(F.col("_known").isNull(), "File not found")
        .when(F.col("duration_sec").isNull(), "Audio processing error")
        .when(F.col("duration_sec") < minimum, "Too short")
    )
    marked = joined.withColumn("reason", reason).drop("_known")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def having_all(df: DataFrame, person: str, category: str, required: Sequence[str]) -> DataFrame:
    """Rows of persons that have every required category (relational division).

    State per person is one flag per required category, added up on the map side.
    """
    flags = [F.max((F.col(category) == r).cast("int")).alias(f"_c{i}") for i, r in enumerate(required)]
    complete = df.groupBy(person).agg(*flags).where(" and ".join(f"_c{i} = 1" for i in range(len(required))))
    return df.join(complete.select(person), person, "left_semi")


def member_of(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*wanted))


def require_classes(df: DataFrame, column: str, wanted: Sequence[str]) -> None:
    """Error if one of the wanted classes has no row left."""
    seen = df.agg(*[F.max((F.col(column) == w).cast("int")).alias(f"_{i}") for i, w in enumerate(wanted)]).first()
    gone = [w for i, w in enumerate(wanted) if not seen[f"_{i}"]]
    if gone:
        raise ContractError(f"no rows left for {column} in {gone}")


def longitudinal(df: DataFrame, mode: str, column: str = "longitudinal") -> DataFrame:
    """``exclude`` keeps 0, ``only`` keeps 1, ``not_one`` keeps all but 1 and so also NULL."""
    if mode == "exclude":
        return df.where(F.col(column) == 0)
    if mode == "only":
        return df.where(F.col(column) == 1)
    if mode == "not_one":
        return df.where(~F.col(column).eqNullSafe(1))
    raise ValueError(f"unknown mode {mode}")


def split_choice(df: DataFrame, chunks: bool, category="recording_category", chunk="chunk_number", value="poem"):
    """Chunks or originals of the chunked category; other categories stay."""
    if chunk not in df.columns:
        df = df.withColumn(chunk, F.lit(None).cast("int"))
    wanted = F.col(chunk).isNotNull() if chunks else F.col(chunk).isNull()
    return df.where(~F.col(category).eqNullSafe(value) | wanted)


def run_filter(
    df: DataFrame, status: str | None = None, contains: Mapping[str, str] = {}, starts: Mapping[str, str] = {},
    unequal: Mapping[str, str] = {}, equal: Mapping[str, str] = {},
) -> DataFrame:
    """Runs by state, name patterns and tags. ``unequal`` keeps rows without the tag."""
    out = df if status is None else df.where(F.col("status") == status)
    for c, v in contains.items():
        out = out.where(F.col(f"`{c}`").contains(v))
    for c, v in starts.items():
        out = out.where(F.col(f"`{c}`").startswith(v))
    for c, v in unequal.items():
        out = out.where(~F.col(f"`{c}`").eqNullSafe(v)) if c in df.columns else out
    for c, v in equal.items():
        out = out.where(F.col(f"`{c}`") == v)
    return out


def varying_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(kept, removed) column names by population variance above 0; one row reaches the driver."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    kept = [c for i, c in enumerate(columns) if (row[f"_{i}"] or 0.0) > 0.0]
    return kept, [c for c in columns if c not in kept]


def feature_group(
    df: DataFrame, names: Sequence[str] = (), prefix: str | None = None, keys: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Projection on a group of feature columns by name or prefix, and the names not found."""
    by_prefix = [c for c in df.columns if prefix is not None and c.startswith(prefix)]
    present = [n for n in names if n in df.columns]
    missing = [n for n in names if n not in df.columns]
    return df.select(*keys, *dict.fromkeys([*present, *by_prefix])), missing
