"""Principal components: sums are distributed, only a dims x dims matrix reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def principal_axes(rows: DataFrame, dims: int, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k axes as rows) of the embeddings; each axis' largest component is positive."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        flat = np.concatenate([[n], total, square.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

    sums = rows.select("embedding").mapInArrow(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    n, total, square = max(sums[0], 1.0), sums[1 : dims + 1], sums[dims + 1 :].reshape(dims, dims)
    mean = total / n
    _, vectors = np.linalg.eigh(square / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :k].T
    return mean, axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]


def project(rows: DataFrame, key: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(key, coordinates)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "coordinates": pa.array(list((_matrix(batch.column(1)) - mean) @ axes.T))})

    return rows.select(key, "embedding").mapInArrow(run, f"{key} long, coordinates array<double>")
