"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions import vocabulary as V
from pairwell.operators.contracts import ContractError
from pairwell.operators.ranking import best_per_group


def read_csv(spark: SparkSession, path, schema: str, separator: str = ",") -> DataFrame:
    """CSV with header and a declared schema; bad numbers become NULL."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def read_indexed_csv(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """``;``-separated CSV whose first column is a row index, which is dropped."""
    df = read_csv(spark, paths, schema, ";")
    return df.drop(df.columns[0])


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One exported sheet (Parquet, or CSV with header); an empty sheet is an error."""
    target = f"{path.rstrip('/')}/{name}"
    reader = spark.read.option("header", True)
    df = reader.csv(target) if target.endswith(".csv") else reader.parquet(target)
    if df.isEmpty():
        raise ContractError(f"sheet {name} is empty")
    return df


def read_predictions(spark: SparkSession, paths: Sequence[str] | str, run_pattern: str = r"/run=?([^/]+)/") -> DataFrame:
    """Union of all prediction files below the paths, with the run taken from the file path."""
    reader = spark.read.option("recursiveFileLookup", True)
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1))


def read_results(
    spark: SparkSession, paths: Sequence[str] | str, default_variant: str, one_per_line: bool = False
) -> DataFrame:
    """Nested result documents: header fields repeated on one row per result, with its configuration key.

    A file holds one document, or one per line.
    """
    raw = spark.read.option("multiLine", not one_per_line).json(paths)
    default = F.lit(default_variant)
    header = F.coalesce(V.VARIANT_FIELD, default) if V.VARIANT_FIELD in raw.columns else default
    rows = raw.select("preproc", header.alias("cohort_variant"), F.explode("results").alias("r")).select(
        "preproc", "cohort_variant", "r.*"
    )
    if "best_params" in rows.columns:
        rows = rows.withColumn("best_params", F.coalesce(F.to_json("best_params"), F.lit("{}")))
    key = F.concat_ws(
        "__", "preproc", "cohort_variant", F.concat(F.col("train_cohort"), F.lit("_to_"), F.col("test_cohort")),
        "splitting", "classifier",
    )
    return rows.withColumn("config_key", key)


def best_by_direction(results: DataFrame) -> DataFrame:
    """All results per direction from the best weighted AUROC down."""
    return best_per_group(results, "direction", "weighted_auroc", ["splitting", "classifier"], n=None)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Embedding store: one folder per layer and category, so that a filter reads only its files.

    Rows of one (layer, category) are spread over several files by recording.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(parts, "layer", "category", F.pmod(F.hash("recording_identifier"), F.lit(parts)))
    write_parquet(spread, path, ["layer", "category"])


def read_embeddings(spark: SparkSession, path: str, layer: int, category: str, statistic: str = "mean") -> DataFrame:
    """Vectors of one layer and category: ``mean``, ``std`` or ``mean_std`` (one after the other)."""
    df = spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("category") == category))
    vector = F.concat("mean", "std") if statistic == "mean_std" else F.col(statistic)
    return df.select("recording_identifier", vector.alias("vector"))
