"""An adaptive sampler over a stream of tries: counts by arm live in keyed state, better arms get more draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = "key string, arm string, tries long, hits long, rank int, share double"


class Arms(StatefulProcessor):
    """State of a key: tries and hits by arm.  After each batch the arms are ranked by their upper confidence bound."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arms = handle.getMapState("arms", StructType([StructField("arm", StringType())]), StructType([StructField("tries", LongType()), StructField("hits", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for arm, own in frame.groupby("arm")["hit"]:
                tries, hits = self.arms.getValue((arm,)) if self.arms.containsKey((arm,)) else (0, 0)
                self.arms.updateValue((arm,), (tries + len(own), hits + int(own.sum())))
        yield pd.DataFrame(ranked(key[0], [(k[0], v[0], v[1]) for k, v in self.arms.iterator()], self.most), columns=["key", "arm", "tries", "hits", "rank", "share"])

    def close(self) -> None:
        pass


def ranked(key: str, arms: list[tuple[str, int, int]], most: int) -> list[tuple]:
    """The best arms with the share of the next draws that each gets, in proportion to its bound."""
    total = sum(t for _, t, _ in arms)
    bound = sorted(((h / t + math.sqrt(2 * math.log(max(total, 2)) / t), a, t, h) for a, t, h in arms), key=lambda x: (-x[0], x[1]))[:most]
    whole = sum(b for b, *_ in bound)
    return [(key, a, t, h, i, round(b / whole, 6)) for i, (b, a, t, h) in enumerate(bound)]


def adaptive(tries: DataFrame, key: str, most: int = 10) -> DataFrame:
    """``tries(key, arm string, hit boolean)`` as a stream -> the ranked arms of each key that got rows.

    A key's arms lie in the state store (RocksDB, ``spark.sql.streaming.stateStore.providerClass``), not in a row."""
    return tries.selectExpr(f"cast(`{key}` as string) as key", "arm", "cast(hit as int) as hit").groupBy("key").transformWithStateInPandas(
        statefulProcessor=Arms(most), outputStructType=OUT, outputMode="Update", timeMode="None")
