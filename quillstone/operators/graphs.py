"""Message passing over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def message_passing(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``nodes(node, x)``, ``edges(src, dst)`` -> (node, x) after rounds of: own value plus the sum of the neighbours' over incoming edges.

    Values are summed before they are joined back, so a node of many neighbours gets one partial sum a task."""
    edges = cut(edges.select("src", "dst").distinct())
    now = nodes.select("node", F.col("x").cast("double").alias("x"))
    for _ in range(rounds):
        sums = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("m"))
        now = cut(now.join(sums, "node", "left").select("node", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x")))
    return now
