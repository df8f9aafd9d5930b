"""Exact nearest neighbours in blocks, neighbour graphs and rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


#: Rows of a block that meet 256 queries at once.
SLAB = 2048
#: Pairs whose exact distances are worked out at once.
PAIRS = 1 << 16


def _blocks(rows: DataFrame, queries: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with (rb, qb) once for each block of queries, queries once for each block of rows; blocks are smaller where tasks would be too few."""
    n, m = rows.count(), queries.count()
    nr, nq = (max(1, -(-c // block)) for c in (n, m))
    while nr * nq < 2 * rows.sparkSession.sparkContext.defaultParallelism and max(n / nr, m / nq) > SLAB:
        nr, nq = (2 * nr, nq) if n / nr >= m / nq else (nr, 2 * nq)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    r = rows.select("*", own("vec_id", nr).alias("rb")).select("*", every(nq).alias("qb"))
    q = queries.withColumnRenamed("vec_id", "query_id").select("*", own("query_id", nq).alias("qb")).select("*", every(nr).alias("rb"))
    return r, q


def _firsts(group: np.ndarray, most: int) -> np.ndarray:
    """Of sorted group numbers, which places are among the first of their group."""
    return np.arange(len(group)) - np.searchsorted(group, group) < most


class _Nearest:
    """The k nearest of up to 256 queries in one block of rows: candidates by a matrix product, settled by exact distances."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, names: np.ndarray, k: int):
        self.x, self.ids, self.y, self.names, self.k = x, ids, y, names, k
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query, row, distance

    def settle(self) -> None:
        q, r = (np.concatenate(c) for c in zip(*self.waiting)) if self.waiting else (np.empty(0, np.int64),) * 2
        self.waiting = []
        d = [np.sqrt(((self.x[r[a : a + PAIRS]] - self.y[q[a : a + PAIRS]]) ** 2).sum(axis=1)) for a in range(0, len(q), PAIRS)]
        q, r, d = (np.concatenate(c) for c in zip(self.best, (q, r, np.concatenate(d) if d else np.empty(0))))
        order = np.lexsort((self.ids[r], d, q))
        order = order[_firsts(q[order], self.k)]
        self.best = q[order], r[order], d[order]

    def search(self, keep_equal: bool, z: np.ndarray, w: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``w @ z.T`` is, within the slack of each query, larger the nearer the row; a query's own vector has half its own square."""
        k, own = self.k, (w[:, :-1].astype(float) ** 2).sum(axis=1) / 2
        top = np.full((len(w), k), -np.inf)  # the k largest so far
        for b in range(0, len(z) if k else 0, SLAB):
            x, ids = self.x[b : b + SLAB], self.ids[b : b + SLAB]
            rough = w @ z[b : b + SLAB].T
            mine = np.flatnonzero(np.isin(ids, self.names))
            at, i = np.nonzero(self.names[:, None] == ids[mine])
            rough[at, mine[i]] = -np.inf
            if not keep_equal:
                at, i = np.divmod(np.flatnonzero(rough >= (own - 2 * slack).astype(np.float32)[:, None]), len(x))
                for a in range(0, len(at), PAIRS):
                    same = (x[i[a : a + PAIRS]] == self.y[at[a : a + PAIRS]]).all(axis=1)
                    rough[at[a : a + PAIRS][same], i[a : a + PAIRS][same]] = -np.inf
            if b == 0:
                n = min(k, len(x))
                top[:, :n] = np.partition(np.nan_to_num(rough, nan=-np.inf, neginf=-np.inf), len(x) - n, axis=1)[:, len(x) - n :]
            limit = np.maximum(top.min(axis=1) - 3 * slack, np.finfo(np.float32).min).astype(np.float32)
            at, i = np.divmod(np.flatnonzero(rough >= limit[:, None]), len(x))
            if b and len(at):
                q, v = np.r_[np.repeat(np.arange(len(top)), k), at], np.r_[top.ravel(), rough[at, i]]
                order = np.lexsort((-v, q))
                top = v[order[_firsts(q[order], k)]].reshape(len(top), k)
            self.waiting.append((at, i + b))
            if sum(len(c[0]) for c in self.waiting) > 4 * PAIRS:
                self.settle()
        self.settle()
        q, r, d = self.best
        return self.names[q], self.ids[r], d


def _halves(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and queries in single precision, such that the product is ``x y - x x / 2`` about the rows' mean, and its error by query."""
    fine = np.isfinite(x).all(axis=1)
    scale = max(np.abs(x[fine]).max(initial=0.0), np.abs(y[np.isfinite(y)]).max(initial=0.0), 1e-300)
    x, y = x / scale, y / scale  # no square overflows
    mean = x[fine].mean(axis=0) if fine.any() else 0.0
    x, y = x - mean, y - mean
    half = (x * x).sum(axis=1) / 2
    most = half[fine].max(initial=0.0)
    error = (x.shape[1] + 8) * 2.0**-23 * (np.sqrt(2 * most * (y * y).sum(axis=1)) + most) + 1e-30
    return np.c_[x, -half].astype(np.float32), np.c_[y, np.ones(len(y))].astype(np.float32), error


def knn(rows: DataFrame, queries: DataFrame, k: int, block: int = 32768, keep_equal: bool = False) -> DataFrame:
    """(query_id, vec_id, dist, rank) of the k nearest other vectors by L2, ties to the smaller id.

    Vectors equal to the query's are left out unless kept.  Vectors that are null, empty or hold null take no part, and
    only vectors of one length meet.  Rows and queries meet in blocks: each task compares one block of rows with one
    block of queries by matrix products in single precision, checks what comes within their error of the k-th so far by
    exact distances and returns the best k of each query, so memory is bounded by the block.  The work is rows times queries."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull())
    own = [F.size("embedding").alias("size"), *[F.col(c).alias(c) for c in ("vec_id", "embedding")]]  # columns of their own, should both come from one table
    r, q = _blocks(*(df.where(usable).select(*own) for df in (rows, queries)), block)

    def nearest(mine: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(mine) and len(asks):
            x, ids = _matrix(mine.column("embedding")), mine.column("vec_id").to_numpy()
            y, names = _matrix(asks.column("embedding")), asks.column("query_id").to_numpy()
            z, w, slack = _halves(x, y)
            out = [_Nearest(x, ids, y[a : a + 256], names[a : a + 256], k).search(keep_equal, z, w[a : a + 256], slack[a : a + 256]) for a in range(0, len(y), 256)]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    key = ["size", "rb", "qb"]
    found = r.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(nearest, "query_id long, vec_id long, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ends(x: np.ndarray, ids: np.ndarray, y: np.ndarray, name: int, rough: np.ndarray, slack: float, near: int, far: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rounded distances) of the rows that are among the nearest or furthest of one query, ties included as far as they are wanted.

    ``rough`` are the squared distances within the slack; rows whose is not finite are always looked at."""
    fine = np.isfinite(rough)
    able = np.ones(len(ids), bool)
    if np.count_nonzero(fine) > near + far:
        f = rough[fine]
        part = np.partition(f, [near - 1, len(f) - far])
        low = (np.sqrt(max(part[near - 1] + slack, 0.0)) + 2 * 10.0**-digits) ** 2 + slack
        high = max(np.sqrt(max(part[len(f) - far] - slack, 0.0)) - 2 * 10.0**-digits, 0.0) ** 2 - slack
        able = ~fine | (rough <= low) | (rough >= high)
    able = np.flatnonzero(able)
    able = able[ids[able] != name]
    total = np.zeros(len(able))
    for c, v in zip(x[able].T, y):  # summed in the order of the components
        total += (c - v) * (c - v)
    d = np.sqrt(total) * 10.0**digits
    whole = np.floor(d)
    d = np.where(np.isfinite(d), whole + (d - whole >= 0.5), d) / 10.0**digits
    own, nan = ids[able], np.isnan(d)
    up, down = np.lexsort((own, d))[:near], np.lexsort((-own, np.where(nan, np.inf, -d), ~nan))[:far]
    both = np.union1d(up, down)
    return own[both], d[both]


def nearest_and_furthest(rows: DataFrame, queries: DataFrame, near: int, far: int, digits: int = 9, block: int = 32768) -> DataFrame:
    """(query_id, vec_id, dist): for each query at least its ``near`` nearest and ``far`` furthest other vectors by L2, rounded.

    Among the nearest ties go to the smaller id, among the furthest to the larger.  A distance is null where a vector is
    null, holds null or has another length; these come last either way.  Rows and queries meet in blocks; a block gives
    each query at most ``2 * (near + far)`` rows."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    own = [F.when(fine, F.size("embedding")).otherwise(-1).alias("size"), F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("embedding")).alias("embedding")]
    r, q = _blocks(*(df.where("vec_id is not null").select(*own) for df in (rows, queries)), block)

    def ends(mine: pa.Table, asks: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        if len(mine) and len(asks):
            size, ids = mine.column("size").to_numpy(), mine.column("vec_id").to_numpy()
            for length in np.unique(asks.column("size").to_numpy()).tolist():
                some = asks.filter(pa.array(asks.column("size").to_numpy() == length))
                names, met = some.column("query_id").to_numpy(), size == (length if length >= 0 else -2)
                away, x, y = np.sort(ids[~met]), np.empty((0, 0)), np.empty((len(some), 0))
                if met.any():
                    x, y = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), length) for t in (mine.filter(pa.array(met)), some))
                own, xx = ids[met], (x * x).sum(axis=1)
                again = int(np.unique(own, return_counts=True)[1].max(initial=0))  # rows of the query's own id take places
                most = xx[np.isfinite(xx)].max(initial=0.0)
                for a in range(0, len(y), 64):
                    yy = (y[a : a + 64] ** 2).sum(axis=1)
                    rough = xx + yy[:, None] - 2.0 * (y[a : a + 64] @ x.T)
                    for i, row in enumerate(rough, a):
                        found, d = _ends(x, own, y[i], names[i], row, 1e-12 * (most + yy[i - a]), near + again, far + again, digits)
                        lost = away[away != names[i]]
                        lost = np.r_[lost[:near], lost[max(near, len(lost) - far) :]]
                        out.append((np.full(len(found) + len(lost), names[i]), np.r_[found, lost], np.r_[d, np.zeros(len(lost))], np.r_[np.zeros(len(found), bool), np.ones(len(lost), bool)]))
        query, vec, d, none = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "dist": pa.array(d, pa.float64(), mask=none)})

    key = ["rb", "qb"]
    return r.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(ends, "query_id long, vec_id long, dist double")


def build_or_load(rows: DataFrame, path: str, cells: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vectors(cell, vec_id, embedding) in folders by cell, centroids) of the index at the path, built first unless complete there.

    Centroids are ``cells`` vectors of smallest hash, so the index is the same whoever builds it."""
    spark = rows.sparkSession
    last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids/_SUCCESS")
    if not last.getFileSystem(spark._jsc.hadoopConfiguration()).exists(last):
        picked = rows.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells).select("vec_id", "embedding").toArrow()  # cells rows
        centers = _matrix(picked.column("embedding"))

        def assign(batches):
            for b in batches:
                if len(b):
                    x = _matrix(b.column("embedding"))
                    cell = ((centers * centers).sum(axis=1) - 2.0 * (x @ centers.T)).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns], ["cell", *b.schema.names])

        kind = dict(rows.dtypes)["embedding"]
        placed = rows.where("embedding is not null").select("vec_id", "embedding").mapInArrow(assign, f"cell int, vec_id long, embedding {kind}")
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame(picked).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    centers = spark.read.parquet(f"{path}/centroids").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").toArrow()
    return spark.read.parquet(f"{path}/vectors"), _matrix(centers.column("embedding"))


def knn_in_cells(index: tuple[DataFrame, np.ndarray], query: list[float], k: int, probes: int) -> DataFrame:
    """The k nearest of one query among the vectors of its nearest cells; other cells' folders are not read."""
    found, centers = index
    q = np.asarray(query, float)
    near = np.argsort(((centers - q) ** 2).sum(axis=1), kind="stable")[:probes]
    asked = F.array(*[F.lit(float(v)) for v in q])
    dist = F.sqrt(F.aggregate(F.zip_with("embedding", asked, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    return found.where(F.col("cell").isin([int(c) for c in near])).select("vec_id", dist.alias("dist")).orderBy("dist", "vec_id").limit(k)


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def neighbourhood_rank(neighbours: DataFrame, top: int = 20, left_out: DataFrame | None = None) -> DataFrame:
    """Queries by the sum of their neighbours' distances, without those of ``left_out(query_id)``."""
    if left_out is not None:
        neighbours = neighbours.join(left_out.select("query_id").distinct(), "query_id", "left_anti")
    return neighbours.groupBy("query_id").agg(F.round(F.sum("dist"), 6).alias("total")).orderBy("total", "query_id").limit(top)


def distinct_texts(neighbours: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``neighbours(query_id, vec_id, dist)``, ``texts(vec_id, text)`` -> the k nearest of different texts, each by its nearest vector."""
    order = [F.asc("dist"), F.asc("vec_id")]
    named = neighbours.select("query_id", "vec_id", "dist").join(texts.select("vec_id", "text"), "vec_id")
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "text").orderBy(*order))).where("nth = 1").drop("nth")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def breadth_first(edges: DataFrame, seed: int, depth: int) -> DataFrame:
    """(node, level) reached from the seed over directed (u, v) edges in up to depth levels."""
    spark = edges.sparkSession
    edges = cut(edges.select("u", "v").distinct())  # the neighbours are searched once, not once a level
    found = frontier = spark.createDataFrame([(seed, 0)], "node long, level int")
    for level in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("u")).join(edges.select("u", F.col("v").alias("node")), "u").select("node").distinct()
        frontier = cut(step.join(found, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
