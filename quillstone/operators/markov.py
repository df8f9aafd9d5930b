"""Order-n token chains: transition tables and seeded walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def transitions(grams: DataFrame) -> DataFrame:
    """(ctx, next) rows -> (ctx, next, n, lo, hi, total): the counts' running interval within the context, by next."""
    n = grams.groupBy("ctx", "next").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ctx")
    hi = F.sum("n").over(w.orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n")).withColumn("total", F.sum("n").over(w))


def walks(table: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(walk, ctx) starts -> (walk, words) after up to steps draws in proportion to the counts.

    Step i of a walk draws from a hash of both; a walk ends in a context without a successor."""
    table = cut(table)
    now = starts.select("walk", F.col("ctx").alias("at"), F.array("ctx").alias("words"))
    for i in range(steps):
        u = F.conv(F.substring(F.md5(F.concat_ws("-", "walk", F.lit(i))), 1, 12), 16, 10).cast("long")
        drawn = now.join(table, F.col("at") == F.col("ctx"), "left")
        pick = F.pmod(u, F.col("total"))
        kept = drawn.where(F.col("ctx").isNull() | ((pick >= F.col("lo")) & (pick < F.col("hi"))))
        now = kept.select("walk", F.col("next").alias("at"), F.when(F.col("next").isNull(), F.col("words")).otherwise(F.concat("words", F.array("next"))).alias("words"))
    return now.select("walk", "words")
