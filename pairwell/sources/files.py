"""Catalogue of recordings from file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions import vocabulary as V


def list_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """Paths below a folder; only the listing is read, not the content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def parse_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """Person, category and date from single and dated file names; other names are left out.

    ``12_a.wav`` is a single recording, ``12_a_20250102.wav`` a dated one. A date that does not exist
    makes the name invalid.
    """
    name = F.element_at(F.split(F.col(column), "/"), -1)
    stem = F.regexp_replace(name, r"\.wav$", "")
    parts = F.split(stem, "_")
    dated = name.rlike(V.DATED_FILE)
    single = name.rlike(V.SINGLE_FILE)
    day = F.when(dated, F.try_to_date(F.get(parts, F.lit(2)), "yyyyMMdd"))
    rows = paths.select(
        F.col(column).alias("audio_sample_path"),
        F.get(parts, F.lit(0)).try_cast("long").alias("audio_id"),
        F.get(parts, F.lit(1)).alias("recording_category"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.when(dated, 1).when(single, 0).alias("longitudinal"),
    )
    return rows.where("longitudinal is not null and (longitudinal = 0 or date is not null)")
