"""From raw sheets and file names to a validated recording table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.functions import frames
from pairwell.functions import vocabulary as V
from pairwell.operators import cohort, contracts, joins, ranking, reshape


def clean_main(raw: DataFrame) -> DataFrame:
    """Main sheet: names, missing values, texts, terms, numbers, then consistency flags.

    The order of the steps matters: texts that mean "missing" are removed before texts are lowered.
    """
    df = frames.rename(frames.normalize_names(raw), {k.lower(): v for k, v in V.MAIN_HEADERS.items()})
    df = frames.trim_lower(frames.null_tokens(df))
    df = frames.standard_terms(df, V.DISEASE_COLUMNS)
    df = frames.numbers(df, V.NUMERIC_COLUMNS)
    df = cohort.unready_questions(df, ["audio_id", "lung_disease_main"])
    if "audio_id" in df.columns:
        contracts.require_empty(df.where(F.col("audio_id").contains(",")).select("audio_id"), "several ids in one field")
        df = df.withColumn("audio_id", E.to_number(F.col("audio_id"), "double").cast("long")).na.drop(subset=["audio_id"])
        contracts.require_empty(df.where("audio_id <= 0").select("audio_id"), "ids must be positive")
    df = frames.numbers(df, ["control", "ready_to_use"])
    df = cohort.ready_only(cohort.unready_contradictions(df))
    return df.drop(*V.DROPPED_COLUMNS, "ready_to_use")


def single_dates(raw: DataFrame, id_map: DataFrame) -> DataFrame:
    """Dates of single recordings by person id: one row per (audio_id, date)."""
    df = frames.rename(frames.normalize_names(raw), {"studien-id": "study_id", "datum": "date"})
    df = frames.trim_lower(frames.null_tokens(df)).withColumn("date", E.iso_date(F.col("date")))
    df = df.select("study_id", "date").na.drop()
    return joins.map_ids(df, id_map.select("study_id", "audio_id"), "study_id").select("audio_id", "date").distinct()


def longitudinal_dates(raw: DataFrame) -> DataFrame:
    """Up to nine date columns to rows, with the temporal order per person."""
    df = frames.rename(frames.normalize_names(raw), {"studien-id": "study_id", "audio-id": "audio_id"})
    columns = [f"datumstimmaufnahme{i}" for i in range(1, 10)]
    long = reshape.melt(frames.null_tokens(df), ["audio_id"], columns, "recording_number", "date")
    dated = long.withColumn("date", E.iso_date(F.col("date"))).na.drop(subset=["date"])
    dated = dated.withColumn("audio_id", E.to_number(F.col("audio_id")).cast("long"))
    ordered = ranking.temporal_order(dated, "audio_id", "date", ["recording_number"])
    return ordered.drop("recording_number")


def recordings(main: DataFrame, singles: DataFrame, longitudinals: DataFrame, files: DataFrame) -> DataFrame:
    """Recording table from cleaned sheets and the file catalogue, with identifiers."""
    contracts.require_empty(
        contracts.shared_ids(main.where("longitudinal = 0"), main.where("longitudinal = 1"), "audio_id"),
        "persons both in and outside follow-up",
    )
    single_files = files.where("longitudinal = 0").drop("longitudinal", "date")
    dated_files = files.where("longitudinal = 1").drop("longitudinal")
    first = joins.attach_single(main, singles, single_files)
    follow_up = joins.attach_longitudinal(longitudinals, dated_files, main)
    table = joins.union_cohorts(first, follow_up).where("audio_sample_path is not null and date is not null")
    return with_identifiers(table)


def with_identifiers(table: DataFrame) -> DataFrame:
    table = frames.ensure_columns(table, {"chunk_number": None}).withColumn("chunk_number", F.col("chunk_number").cast("int"))
    problem = E.recording_problem(F.col("date"), F.col("chunk_number"))
    contracts.require_empty(table.where(problem.isNotNull()).select("audio_id", problem.alias("problem")), "no identifier possible")
    out = table.withColumn(
        "recording_identifier",
        E.recording_identifier(F.col("audio_id"), F.col("recording_category"), F.col("date"), F.col("chunk_number")),
    )
    return out


def merge_sources(local: DataFrame, crowd: DataFrame, durations: DataFrame, minimum: float = 3.0) -> DataFrame:
    """Two cohorts in one table: derived columns, union, duration gate, identifiers, contract."""
    local = frames.ensure_columns(local.withColumn("data_source", F.lit(V.LOCAL_SOURCE)), {"language": "de"})
    local = local.withColumn("age", E.age_at(V.REFERENCE_YEAR, F.col("birth_year")))
    local = local.withColumn("age_group", E.decade(F.col("age")))
    crowd = frames.ensure_columns(crowd, {"data_source": V.CROWD_SOURCE})
    if "age_group" not in crowd.columns:
        crowd = crowd.withColumn("age_group", E.decade(F.col("age")))
    merged = joins.union_cohorts(local, crowd)
    kept, _ = cohort.duration_gate(merged, durations, "audio_sample_path", minimum)
    return with_identifiers(kept)


def validate(table: DataFrame) -> DataFrame:
    """Raise if a row breaks the contract or an identifier occurs twice; else the table."""
    contracts.require_empty(contracts.row_findings(table), "rows break the recording contract")
    contracts.require_empty(contracts.duplicates(table, ["recording_identifier"]), "identifiers are not unique")
    return table


def clean_crowd(raw: DataFrame, steps: dict, order: Sequence[str]) -> DataFrame:
    """Crowd-sourced metadata: one-hot history and symptoms, eligibility, ages, ids."""
    df = frames.one_hot(frames.one_hot(raw, "Medhistory"), "Symptoms")
    df = df.withColumn("date", E.year_first(F.col("Date")))
    df = cohort.eligible(df, steps)
    df = frames.fill_ages_from_ranges(df, "Age", "age")
    df = df.withColumn("sex", E.lookup(F.col("Sex"), {"Female": "w", "Male": "m"})) if "Sex" in df.columns else df
    return ranking.first_seen_ids(df, "Uid", order, 3001, "audio_id")
