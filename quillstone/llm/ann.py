"""Nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking within proven bounds.

The index is fitted on a bounded sample (``SAMPLE`` vectors of smallest hash): k-means centroids, and for each of
``PARTS`` sub-spaces 256 centroids of the residuals.  Every row is indexed: its list and its code.  Lists are
packed into shards of bounded size (a large list takes several, dealt by hash), and each index row is shuffled once.
A query goes once to each shard that holds one of its probed lists.  A task holds one shard, at most about ``SHARD``
vectors, and the queries stream by: asymmetric tables (query sub-vector times sub-centroid) score the codes, and all
that can be among the nearest are reranked by cosine on the original vectors in double precision.

Nothing near is missed.  A query's best cosines in the sample are a floor for its best in the table.  A cosine exceeds
the code's score by no more than the distance of the unit vector from what its code stands for, and a list's by no
more than the list's radius, so lists and vectors that stay below the floor by that bound are left out and no others.

Copies of a vector: only the k + 1 smallest ids of equal vectors are indexed, which is exact, since ties go to
smaller ids; equal query vectors are searched once.  Both keep a vector with very many copies from skewing.

Random directions are the hard case: there no list can be ruled out, and codes rule out most vectors, not most work.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components and rows of null vec_id take no
part; queries meet candidates of their own length only, each length has its own index; repeated rows count once;
fewer candidates than k are all returned, as far as they are found; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table
from .vectors import cosines, matrix, sizes, unit, usable

SAMPLE = 20_000
PARTS = 16
SHARD = 4096
SLACK = 1e-9  # far above the rounding of a cosine


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm; empty clusters take a random point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(x.shape[1]):
            s = np.bincount(near, x[:, j], minlength=len(c))
            c[:, j] = s
        n = np.bincount(near, minlength=len(c))
        c[n > 0] /= n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ c.T - half).argmax(axis=1)
    return out


class Index:
    """Centroids of the lists and of the residuals' sub-spaces: bounded by SAMPLE, not by the table."""

    def __init__(self, sample: np.ndarray, rows: int, parts: int = PARTS):
        x = self.sample = unit(sample)
        d = x.shape[1]
        self.lists = kmeans(x, int(np.clip(round(rows**0.5), 1, 4096)))
        self.cuts = np.linspace(0, d, min(parts, d) + 1).astype(int)
        rest = x - self.lists[nearest(x, self.lists)]
        self.codes = [kmeans(rest[:, a:b], 256, seed=7 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, distance from the list's centroid and from what list and code stand for."""
        x = unit(x)
        at = nearest(x, self.lists)
        rest = x - self.lists[at]
        far = np.linalg.norm(rest, axis=1)
        code = np.stack([nearest(rest[:, a:b], c) for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)], axis=1).astype(np.uint8)
        for m, (a, b, c) in enumerate(zip(self.cuts, self.cuts[1:], self.codes)):
            rest[:, a:b] -= c[code[:, m]]
        return at, code, far, np.linalg.norm(rest, axis=1)

    def floor(self, q: np.ndarray, most: int) -> np.ndarray:
        """Per query a cosine that at least ``most`` vectors of the table reach."""
        if len(self.sample) < most:
            return np.full(len(q), -2.0)
        return np.partition(unit(q) @ self.sample.T, len(self.sample) - most, axis=1)[:, len(self.sample) - most] - SLACK

    def probe(self, q: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) for each list, of those that have a radius, that can hold a vector at the floor."""
        return np.nonzero(unit(q) @ self.lists[: len(radius)].T + radius >= floor[:, None])

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]


_RESULT = "query_id long, rank int, vec_id long, score double"


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``rows(vec_id, embedding)``, ``queries(vec_id, embedding)`` -> (query_id, rank, vec_id, score)."""
    own, asked = _usable(rows), _usable(queries).withColumnRenamed("vec_id", "query_id").distinct()
    same = Window.partitionBy("embedding").orderBy("vec_id")
    own = own.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1)
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("nth"))).where("nth = 1").drop("nth")
    found = [_search(own, asked, size, count, k) for size, count in sizes(own)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], _RESULT)


def _shards(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """First shard and number of shards of each list: small lists share one, a large list takes several; all about equally full."""
    total = sum(counts.values())
    most = -(-total // -(-total // SHARD))
    first, pieces = np.zeros(max(counts) + 1, np.int32), np.zeros(max(counts) + 1, np.int32)
    shards = filled = 0
    for lst in sorted(counts):
        n = counts[lst]
        if filled and filled + n > 1.1 * most:
            shards, filled = shards + 1, 0
        first[lst] = shards
        pieces[lst] = max(1, -(-n // most))
        if n > most:
            shards += int(pieces[lst])
        else:
            filled += n
    return first, pieces, shards + (filled > 0)


def _search(own: DataFrame, asked: DataFrame, size: int, count: int, k: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = own.sparkSession
    own, asked = own.where(F.size("embedding") == size), asked.where(F.size("embedding") == size)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    index = spark.sparkContext.broadcast(Index(matrix(sample.column("embedding"), size), count))
    kind = dict(own.dtypes)["embedding"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, code, far, off = index.value.assign(matrix(b.column("embedding"), size))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(far), pa.array(off)],
                ["vec_id", "embedding", "list", "code", "far", "bound"])

    indexed = checkpointed(own.mapInArrow(assign, f"vec_id long, embedding {kind}, list int, code binary, far double, bound double"))
    # lists packed into shards: at most one row per list comes to the driver
    lists = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    first, pieces, shards = _shards({r["list"]: r["n"] for r in lists})
    radius = np.full(len(first), -np.inf)
    radius[[r["list"] for r in lists]] = [r["far"] for r in lists]
    where = spark.sparkContext.broadcast((first, pieces, radius))
    distinct = checkpointed(asked.groupBy("embedding").agg(F.min("query_id").alias("q")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes once to each shard that holds some of its lists."""
        first, pieces, radius = where.value
        for b in batches:
            for at in range(0, len(b), 256):
                own = b.slice(at, 256)
                if not len(own):
                    continue
                q = matrix(own.column("embedding"), size)
                floor = index.value.floor(q, k + 1)
                row, lst = index.value.probe(q, radius, floor)
                n = pieces[lst]  # a list of several shards is looked for in each of them
                to = np.repeat(first[lst] + n - np.cumsum(n), n) + np.arange(n.sum())
                pairs = np.unique(np.repeat(row, n) * shards + to)
                take = pa.array(pairs // shards, pa.int64())
                none = pa.nulls(len(take), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs % shards, pa.int32()), pa.array(np.ones(len(take), np.int32)), own.column("q").take(take), own.column("embedding").take(take), none, pa.nulls(len(take), pa.binary()), pa.array(floor).take(take)],
                    ["shard", "asks", "id", "embedding", "list", "code", "bound"])

    fields = f"shard int, asks int, id long, embedding {kind}, list int, code binary, bound double"  # a vector's distance from its code, a query's floor
    sent = distinct.mapInArrow(route, fields)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")  # deals a large list over its shards

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pieces, _ = where.value
        for b in batches:
            lst = b.column("list").to_numpy()
            shard = first[lst] + b.column("spread").to_numpy() % pieces[lst]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(np.zeros(len(b), np.int32)), b.column("vec_id"), b.column("embedding"), b.column("list"), b.column("code"), b.column("bound")],
                ["shard", "asks", "id", "embedding", "list", "code", "bound"])

    placed = indexed.withColumn("spread", spread).mapInArrow(place, fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first and are held, the queries that ask it stream by."""
        shard, held, ready = None, [], None
        for b in batches:
            for t, asks in _segments(b):
                if t.column("shard")[0].as_py() != shard:
                    shard, held, ready = t.column("shard")[0].as_py(), [], None
                if not asks:
                    held.append(t)
                elif held:
                    ready = ready or _Shard(pa.Table.from_batches(held), size)
                    for at in range(0, len(t), 128):
                        yield ready.answer(t.slice(at, 128), index.value, k + 1)

    work = placed.unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks")
    found = work.mapInArrow(scan, "q long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    each = asked.join(distinct, "embedding").select("q", "query_id").join(best, "q").where("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _segments(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batch cut where the shard or the kind of row changes."""
    if not len(b):
        return
    shard, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
    cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
    for a, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(b)].tolist()):
        yield b.slice(a, e - a), bool(asks[a])


class _Shard:
    """A bounded part of the index in a task's memory, its vectors by list."""

    def __init__(self, rows: pa.Table, size: int):
        lists = rows.column("list").to_numpy()
        order = np.argsort(lists, kind="stable")
        self.size, self.lists = size, lists[order]
        self.ids = rows.column("id").to_numpy()[order]
        self.x = matrix(rows.column("embedding"), size)[order]
        self.code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(lists), -1)[order]
        self.off = rows.column("bound").to_numpy()[order]
        self.unit = unit(self.x)
        self.names, self.at = np.unique(self.lists, return_inverse=True)

    def answer(self, asks: pa.RecordBatch, index: Index, most: int) -> pa.RecordBatch:
        """Each query's best of the shard: all that can reach its floor are compared exactly."""
        q, names, floor = matrix(asks.column("embedding"), self.size), asks.column("id").to_numpy(), asks.column("bound").to_numpy()
        uq = unit(q)
        score = (uq @ index.lists[self.names].T)[:, self.at] + self.off
        for m, t in enumerate(index.tables(uq)):
            score += t[:, self.code[:, m]]
        out = []
        for i in range(len(q)):
            able = np.flatnonzero(score[i] >= floor[i])
            rough = self.unit[able] @ uq[i]
            least = np.partition(rough, len(rough) - most)[len(rough) - most] - SLACK if len(rough) > most else -2.0
            able = able[rough >= max(least, floor[i])]
            exact = cosines(self.x[able], np.broadcast_to(q[i], (len(able), self.size)))
            best = np.lexsort((self.ids[able], -exact))[:most]
            out.append((np.full(len(best), names[i]), self.ids[able][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["q", "vec_id", "score"])


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
