"""Structured Streaming forms: online rebalancing, running counts, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import rebalanced


def rebalance_online(stream: DataFrame, label: str, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is cut to its rarest label and written under its batch id, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rebalanced(batch, label, F.md5(F.col(key).cast("string")), F.col(key)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_hits(stream: DataFrame, group: str, hit) -> DataFrame:
    """(group, hits, total), in update mode."""
    return stream.groupBy(group).agg(F.sum(hit.cast("long")).alias("hits"), F.count(F.lit(1)).alias("total"))


def tumbling(stream: DataFrame, ts: str, size: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def seen_once(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
