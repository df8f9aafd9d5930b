"""Distributions, ranking metrics, stratified windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_frequency(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """(key, n, freq); totals come from the aggregated rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row; a window without keys would move all counts to one task
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_total"), digits).alias("freq"))


def cumulative(df: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, n, cdf) over the buckets; the window sorts buckets, not rows."""
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cdf", F.round(run / F.sum("n").over(Window.partitionBy()), 6))


def take_per_group(df: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= k).drop("nth")


def running(df: DataFrame, group: str, block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals per group in two levels, so that a hot group is spread over its blocks.

    The block must not fall along the order.  Totals of (group, block) run over the few blocks of a group, the
    rows' own totals inside one block; columns named after sums are added."""
    rows = df.withColumn("_block", block).select("*", *[v.cast("long").alias(f"_{k}") for k, v in sums.items()])
    blocks = rows.groupBy(group, "_block").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{k}": F.sum(f"_{k}").over(inside) for k in sums})
    out = out.join(blocks, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b")))
    return out.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums])


def hash_block(digest: Column, digits: int = 4) -> Column:
    """Block of an order by hexadecimal digests: their leading digits."""
    return F.substring(digest, 1, digits)


def rebalanced(df: DataFrame, label: str, digest: Column, *ties: Column) -> DataFrame:
    """As many rows of each label as the rarest label has, first by a hexadecimal digest, then by the ties."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
    ranked = running(df, label, hash_block(digest), [digest, *ties], {"_nth": F.lit(1)})
    return ranked.join(F.broadcast(least), F.col("_nth") <= F.col("_least")).drop("_nth", "_least")  # one row


def ranking_metrics(ranks: DataFrame, rank0: str, ks: tuple[int, ...] = (1, 5, 10), *by: str) -> DataFrame:
    """MRR and P@k of 0-based ranks, -1 for absent."""
    r = F.col(rank0)
    cols = [F.round(F.avg(F.when(r >= 0, 1.0 / (r + 1)).otherwise(0.0)), 6).alias("mrr")]
    cols += [F.round(F.avg(((r >= 0) & (r < k)).cast("double")), 6).alias(f"p_at_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cols)


def paired_t(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Paired t statistic of a - b; null for fewer than 3 pairs or no spread."""
    d = F.col(a).cast("double") - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return out.select(*by, "n", F.when((F.col("n") > 2) & (F.col("s") > 0), F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 6)).alias("t"))


def running_hits(df: DataFrame, group: str, order: str, hit: Column, width: int = 1 << 16) -> DataFrame:
    """Running (hits, total) per group along an integer order, in blocks of the given width."""
    return running(df, group, F.floor(F.col(order) / width), [F.col(order)], {"hits": hit, "total": F.lit(1)})
