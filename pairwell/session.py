"""Session helpers: shared checkpoint folder, durable cuts of a plan, scratch paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as the session names it.

    A temporary folder is used only if a local session names none, which is the case in unit tests. On a cluster
    executors could not read it, so a session there has to name one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and cut its lineage.

    Used where a value must not change on recomputation (range partition ids) and between the
    rounds of an iterative job. The files survive the loss of executors.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Store ``df`` as files in place of what ``path`` held, and read it back.

    For what a loop hands from round to round: a checkpoint keeps the estimated size of its plan, in which each join
    multiplies, so over rounds the estimate becomes a number that fills the driver. Files have their real size.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables that are written and read back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
