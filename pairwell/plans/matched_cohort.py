"""From a recording table to a matched cohort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.functions import vocabulary as V
from pairwell.operators import cohort, joins, matching
from pairwell.operators.propensity import propensity_scores
from pairwell.session import durable


@dataclass
class MatchSpec:
    """Parameters of a matching run."""

    k: int = 5
    caliper: float = 0.2
    age_caliper: float | None = None
    exact: Sequence[str] = ()
    covariates: Sequence[str] = ()
    use_age: bool = True
    age_squared: bool = True
    report: Sequence[str] = ()
    max_rows: int = matching.MAX_ROWS


@dataclass
class MatchResult:
    scored: DataFrame
    pairs: DataFrame
    matched: DataFrame
    smd: DataFrame
    drops: DataFrame = field(repr=False)


def person_table(
    recordings: DataFrame,
    covariates: DataFrame,
    source: str,
    covariate_columns: Sequence[str],
    order: Sequence[str],
    required: Sequence[str] = (),
    exclude_longitudinal: bool = False,
    reference_year: int = V.REFERENCE_YEAR,
) -> DataFrame:
    """Eligible persons with covariates, age and label. Eligibility comes before any matching."""
    rows = recordings.where(F.col("data_source") == source)
    if required:
        rows = cohort.having_all(rows, "audio_id", "recording_category", required)
    if exclude_longitudinal:
        rows = cohort.longitudinal(rows, "not_one")
    persons = cohort.keep_first(rows, ["audio_id"], order)
    joined = persons.join(covariates.select("audio_id", *[c for c in covariates.columns if c not in persons.columns]), "audio_id", "left")
    flags = {
        c: F.coalesce(E.to_number(F.col(c)), F.lit(0.0)).cast("int") if c in joined.columns else F.lit(0)
        for c in covariate_columns
    }
    derived = joined.withColumns(flags).withColumns(
        {
            "age": E.age_at(reference_year, F.col("birth_year")).cast("double"),
            "label": E.lookup(F.col("lung_disease_main"), {"copd": 1, "control": 0}),
            "sex": E.trim_lower(F.col("sex").cast("string")),
        }
    )
    return derived.where("label is not null and age is not null")


def match(persons: DataFrame, spec: MatchSpec, id_column: str = "person_id", order: str | None = None) -> MatchResult:
    """Score, trim, match and report. The scored persons are stored once, since every step reads them."""
    scored = propensity_scores(persons, "label", spec.covariates, spec.use_age, spec.age_squared)
    scored = durable(matching.with_stratum(scored, spec.exact))
    kept = matching.support_and_caliper(scored, spec.caliper)
    pairs = durable(
        matching.greedy_match(
            kept, spec.k, id_column, order, age_caliper=spec.age_caliper, max_rows=spec.max_rows
        )
    )
    matched = matching.matched_long(scored, pairs, id_column)
    smd = matching.balance(scored, matched, list(spec.report or spec.covariates), ["age"])
    drops = matching.drop_reasons(scored, kept, pairs, id_column=id_column, age_caliper=spec.age_caliper)
    return MatchResult(scored, pairs, matched, smd, drops)


def match_swapped(persons: DataFrame, spec: MatchSpec, id_column: str = "person_id", order: str | None = None) -> MatchResult:
    """Rare controls choose cases: labels are exchanged for the matching and restored afterwards."""
    swapped = persons.withColumns({"orig_label": F.col("label"), "label": 1 - F.col("label")})
    found = match(swapped, spec, id_column, order)
    restore = lambda df: df.withColumn("label", F.col("orig_label")).drop("orig_label")
    scored, matched = restore(found.scored), restore(found.matched)
    smd = matching.balance(scored, matched, list(spec.report or spec.covariates), ["age"])
    return MatchResult(scored, found.pairs, matched, smd, found.drops)


def ratio_sweep(persons: DataFrame, spec: MatchSpec, ratios: Sequence[int], id_column: str = "person_id") -> DataFrame:
    """Cohort size and worst imbalance for several matching ratios; scores are fitted once."""
    scored = propensity_scores(persons, "label", spec.covariates, spec.use_age, spec.age_squared)
    scored = durable(matching.with_stratum(scored, spec.exact))
    kept = durable(matching.support_and_caliper(scored, spec.caliper))
    out = None
    for k in ratios:
        pairs = durable(matching.greedy_match(kept, k, id_column, age_caliper=spec.age_caliper, max_rows=spec.max_rows))
        matched = durable(matching.matched_long(scored, pairs, id_column))
        smd = matching.balance(scored, matched, list(spec.report or spec.covariates), ["age"])
        row = matched.agg(
            F.lit(k).alias("k"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("label") == 1).alias("n_cases"),
            F.count_if(F.col("label") == 0).alias("n_controls"),
        ).withColumn("max_abs_smd", smd.agg(F.max(F.abs("smd_after"))).scalar())
        # The figures of a ratio are made before the next is matched: the plans of all ratios together, with
        # what each broadcasts, would meet in the driver.
        row = durable(row)
        out = row if out is None else out.unionByName(row)
    return out


def demographics(persons: DataFrame, label: str = "label", top: int = 5) -> DataFrame:
    """Age, sex and language of cases and controls as rows of (group, figure, value, n)."""
    ages = persons.groupBy(label).agg(F.avg("age").alias("mean"), F.stddev_samp("age").alias("sd"), F.count("age").alias("n"))
    rows = ages.unpivot([label, "n"], ["mean", "sd"], "figure", "value").select(
        label, F.concat(F.lit("age_"), "figure").alias("figure"), "value", "n"
    )
    from pairwell.operators.reshape import top_values

    out = rows
    for column in ("sex", "language"):
        if column in persons.columns:
            ranked = top_values(persons, label, column, top)
            out = out.unionByName(
                ranked.select(
                    label, F.concat(F.lit(column + "_"), F.coalesce(F.col(column).cast("string"), F.lit("?"))).alias("figure"),
                    F.lit(None).cast("double").alias("value"), "n",
                )
            )
    return out


def recordings_of(recordings: DataFrame, matched: DataFrame, source: str, person: str = "audio_id") -> DataFrame:
    """All recordings of matched persons, of one source only."""
    return joins.keep_matched(recordings.where(F.col("data_source") == source), matched, person)
