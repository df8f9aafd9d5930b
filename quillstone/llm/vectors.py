"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not the zero vector."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0.0), F.lit(False))


def sizes(rows: DataFrame) -> list[tuple[int, int]]:
    """The vectors' lengths and how many have each (vectors of one model have one length); each length is worked on by itself."""
    return sorted((r["d"], r["n"]) for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors of one size, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # large components don't overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in one order of summation, so that equal rows get equal results."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
