"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import EACH, few
from pairwell.session import durable


def durable_few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with its lineage cut. That a small one is one partition is said again, for a checkpoint forgets it."""
    return few(durable(few(df, rows)), rows)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the edges (a, b); ``comp`` is the smallest node that can be reached.

    Every round takes the smallest label among the neighbours and then the label of that label, so long chains
    need a logarithmic number of rounds. Minima are combined before rows are shuffled, so hubs stay harmless. Labels of
    up to ``EACH`` rows are broadcast: a shuffle of so few would cost a task and its sort buffers for each partition.
    """
    rows = 2 * edges.count()
    near = F.broadcast if rows <= EACH else lambda df: df
    both = few(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
    labels = durable_few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), rows)
    while True:
        seen = both.join(near(labels.select(F.col("node").alias("a"), "comp")), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        lower = seen.join(near(labels), "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        labels_next = durable_few(lower.join(near(jump), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "old"), rows)
        changed = not labels_next.where(F.col("comp") != F.col("old")).isEmpty()
        labels = labels_next.select("node", "comp")
        if not changed:
            return labels
