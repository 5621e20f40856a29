"""Data contracts: findings are DataFrames; ``require_empty`` turns findings into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.functions import vocabulary as V


class ContractError(ValueError):
    """A table breaks its contract."""


def require_empty(findings: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first few findings, if there are any."""
    first = findings.limit(show).collect()
    if first:
        raise ContractError(f"{what}: {[r.asDict() for r in first]}")


def id_findings(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id is a list, not a number, not whole or not positive."""
    text = F.col(column).cast("string")
    number = E.to_number(text)
    problem = (
        F.when(text.contains(","), "several ids")
        .when(number.isNull(), "not a number")
        .when(number % 1 != 0, "not whole")
        .when(number <= 0, "not positive")
    )
    return df.withColumn("problem", problem).where("problem is not null")


def row_findings(df: DataFrame) -> DataFrame:
    """One row per broken rule of the recording table."""
    c = F.col

    def out(name, low, high, low_open=False):
        bad = (c(name) <= low) if low_open else (c(name) < low)
        return c(name).isNotNull() & (bad | (c(name) > high)) if high is not None else c(name).isNotNull() & bad

    expected = E.recording_identifier(c("audio_id"), c("recording_category"), c("date"), c("chunk_number"))
    rules = {
        "audio_id must be positive": c("audio_id").isNull() | (c("audio_id") <= 0),
        "audio_sample_path is required": c("audio_sample_path").isNull(),
        "birth_year outside 1900..2030": out("birth_year", 1900, 2030),
        "height_cm outside (0, 300]": out("height_cm", 0, 300, True),
        "weight_kg outside (0, 500]": out("weight_kg", 0, 500, True),
        "unknown lung_disease_main": ~F.coalesce(c("lung_disease_main").isin(*V.DISEASES), F.lit(False)),
        "unknown recording_category": ~F.coalesce(c("recording_category").isin(*V.CATEGORIES), F.lit(False)),
        "unknown data_source": c("data_source").isNotNull() & ~c("data_source").isin(*V.SOURCES),
        "longitudinal must be 0 or 1": ~F.coalesce(c("longitudinal").isin(0, 1), F.lit(False)),
        "date must be YYYY-MM-DD": ~F.coalesce(c("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "chunk_number below 1": out("chunk_number", 1, None),
        "chunk_start_sec below 0": out("chunk_start_sec", 0, None),
        "chunk_duration_sec not above 0": out("chunk_duration_sec", 0, None, True),
        "recording_identifier differs from its key": ~c("recording_identifier").eqNullSafe(expected),
    }
    messages = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()]))
    return df.select("audio_id", "recording_identifier", F.explode(messages).alias("problem"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ContractError(f"missing required columns: {missing}")


def shared_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Ids present in both groups (none are allowed)."""
    return left.select(column).distinct().join(right.select(column), column, "left_semi")


def leaks(df: DataFrame, fold: str, person: str, part: str) -> DataFrame:
    """Persons on more than one side of a split; bounded state per (fold, person)."""
    return (
        df.groupBy(fold, person)
        .agg(F.min(part).alias("first_part"), F.max(part).alias("last_part"))
        .where("first_part <> last_part")
    )


def label_conflicts(df: DataFrame, person: str, label: str) -> DataFrame:
    """Persons whose rows carry different labels."""
    return (
        df.groupBy(person)
        .agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count_if(F.col(label).isNull()).alias("n_null"))
        .where("low <> high or (n_null > 0 and high is not null)")
    )


def language_gate(df: DataFrame, language: str) -> DataFrame:
    """One row: number of distinct languages and whether a comparison makes sense."""
    n = F.countDistinct(language)
    return df.agg(n.alias("n_languages"), (n > 1).alias("compare"))
