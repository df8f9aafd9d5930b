"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut as checkpointed
from ..operators.lineage import shared_folder

__all__ = ["NO_ID", "WHITE", "WORD", "checkpointed", "runs", "shared_folder", "shuffle_partitions", "stored", "strings", "table", "tidy", "word_count"]

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id in join keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: for rows that compress well and are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: nothing to give back


def strings(column: pa.Array) -> Iterator[str | None]:
    """Python strings of a column, some rows at a time: a batch's texts are never held twice."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted rows as tables of whole runs of equal keys, with the runs' starts and ends; memory holds a batch and one run."""
    held: list[pa.RecordBatch] = []  # the last run so far
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in key:
            c = t.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        held = t.slice(starts[-1]).to_batches()
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts[:-1], starts[1:]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.zeros(1, np.int64), np.array([len(t)])
