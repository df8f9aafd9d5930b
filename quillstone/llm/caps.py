"""Embedding near-dedup by spherical-cap filters (locality-sensitive filtering with random product codes).

A filter is a unit direction; a vector is in the ``PASSES`` filters nearest to it, so its cap's height is its own and
no vector is left out.  Directions are structured: the rotated space is cut in two halves, each half has a random
code, and a filter is one code word of each, so the nearest filters are found among the best words of the halves.
There are as many filters as make a filter hold ``MEMBERS`` vectors on average, at every size.

A pair is lost if it shares no filter of any code.  A code's rotation is uniform, so the chance depends only on the
pair's cosine, not on the data: it is measured for the table's size on random pairs at the threshold, and codes are
added until it is at most ``MISSED``.

Vectors join on (label, filter) in two steps.  First only 128-bit sign sketches travel: a vector stays in a filter if
another one of it is within ``_reach`` bits, which a pair at the threshold exceeds with a chance of at most ``SKETCH_MISSED``.
Then the embeddings of those that stay travel, and cosines are verified.  A task sees at most two blocks of a
filter's vectors, so a filter of very many is dealt over many tasks; it counts a pair only in the smallest filter that
both are in (filters are decoded anew, not shipped), and returns sums of links and a spanning forest, never the pairs.

Copies are one class: a class is compared once and weighs as many vectors.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components, rows of null label and rows of
null vec_id link with nothing (component_id is the own vec_id); vectors of different lengths never link, each length
is compared by itself; repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, runs, table
from .graph import connected_components
from .vectors import matrix, sizes, unit, usable

COSINE = 0.93
PASSES = 4
MEMBERS = 4096
MISSED = 1e-5
SKETCH_MISSED = 1e-7
SKETCH_BITS = 128
MODEL_PAIRS = 4000
BLOCK = 2048
#: Filters of several blocks are broadcast up to this number, joined otherwise.
HOT_BROADCAST = 100_000
SEED = 11


class Code:
    """Random product code of a space: its size follows the number of vectors."""

    def __init__(self, size: int, rows: int, seed: int = SEED, passes: int = PASSES):
        rng = np.random.default_rng(seed)
        want = max(64, rows * passes / MEMBERS)
        blocks = 1 if size < 8 else 2
        words = int(np.ceil(want ** (1 / blocks)))
        self.passes = passes
        self.turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.cuts = np.linspace(0, size, blocks + 1).astype(int)
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((words, b - a))
            self.words.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.count = words**blocks

    def decode(self, x: np.ndarray) -> np.ndarray:
        """For each unit vector the numbers of the filters nearest to it, a row of ``passes`` each."""
        step = max(1, (1 << 22) // len(self.words[0]))
        parts = [self._nearest(x[i : i + step] @ self.turn) for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.empty((0, self.passes), np.int64)

    def _nearest(self, y: np.ndarray) -> np.ndarray:
        total = name = None
        for (a, b), c in zip(zip(self.cuts, self.cuts[1:]), self.words):
            p = y[:, a:b] @ c.T
            k = min(self.passes, len(c))
            able = np.argpartition(-p, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(p, able, axis=1)
            order = np.argsort(-best, axis=1)
            best, able = np.take_along_axis(best, order, axis=1), np.take_along_axis(able, order, axis=1)
            if total is None:
                total, name = best, able.astype(np.int64)
                continue
            # the i-th and j-th best words of the halves have i * j better or equal sums, themselves included
            i, j = np.nonzero(np.outer(np.arange(1, total.shape[1] + 1), np.arange(1, k + 1)) <= self.passes)
            sums, names = total[:, i] + best[:, j], name[:, i] * len(c) + able[:, j]
            top = np.argpartition(-sums, self.passes - 1, axis=1)[:, : self.passes]
            total, name = np.take_along_axis(sums, top, axis=1), np.take_along_axis(names, top, axis=1)
        return np.sort(name, axis=1)


def pairs_at(cosine: float, size: int, pairs: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at one cosine."""
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((pairs, size)))
    if size == 1:
        return x, x
    aside = rng.standard_normal((pairs, size))
    return x, cosine * x + (1 - cosine**2) ** 0.5 * unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)


def missed(code: Code, size: int, pairs: int = MODEL_PAIRS) -> float:
    """Share of random pairs at the threshold that have no filter of the code in common."""
    x, y = pairs_at(COSINE, size, pairs)
    f, g = code.decode(x), code.decode(y)
    return float((f[:, :, None] != g[:, None, :]).all(axis=(1, 2)).mean())


def _reach() -> int:
    """Most sketch bits in which a pair at the threshold differs, but for a chance of SKETCH_MISSED."""
    p, tail, at = np.arccos(COSINE) / np.pi, 1.0, -1
    while tail > SKETCH_MISSED:
        at += 1
        tail -= comb(SKETCH_BITS, at) * p**at * (1 - p) ** (SKETCH_BITS - at)
    return at


class Filters:
    """As many independent codes as lose at most MISSED of the pairs at the threshold, and the sketch's hyperplanes."""

    def __init__(self, size: int, rows: int):
        first = Code(size, rows, SEED)
        lost = (missed(first, size) * MODEL_PAIRS + 1) / (MODEL_PAIRS + 1)
        more = int(np.ceil(np.log(MISSED) / np.log(min(lost, 0.9))))
        self.codes = [first] + [Code(size, rows, SEED + i) for i in range(1, more)]
        self.planes = np.random.default_rng(SEED - 1).standard_normal((size, SKETCH_BITS))
        self.reach = _reach()

    def decode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([code.decode(x) + k * code.count for k, code in enumerate(self.codes)], axis=1)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1).view(np.int64)


def _local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable, over a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(linked[a : a + 256], label[None, :], n).min(axis=1, initial=n) for a in range(0, n, 256)])
        now = np.minimum(label, low)
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def _compare(x, weight, filters: np.ndarray, part, mine: int):
    """Links inside one block, or between two, whose smallest common filter is this one, and a forest of all links."""
    n = len(x)
    close = np.zeros((n, n), bool)
    for a in range(0, n, 512):
        close[a : a + 512] = x[a : a + 512] @ x.T >= COSINE - 1e-9
    if part.min() != part.max():
        close &= part[:, None] != part[None, :]
    a, b = np.nonzero(np.triu(close, 1))
    close[:] = False
    fine = np.empty(len(a), bool)
    for s in range(0, len(a), 1 << 16):  # the comparison that counts, in one order of summation
        t = slice(s, s + (1 << 16))
        fine[t] = (x[a[t]] * x[b[t]]).sum(axis=1) >= COSINE
    a, b = a[fine], b[fine]
    if not len(a):
        return None
    close[a, b] = close[b, a] = True
    root = _local_components(close)
    # pairs by the kinds of lower filters that their ends are in: few in a tight group
    kinds, kind = np.unique(np.where(filters < mine, filters, -1), axis=0, return_inverse=True)
    pair, at = np.unique(kind.ravel()[a] * len(kinds) + kind.ravel()[b], return_inverse=True)
    first = np.empty(len(pair), bool)
    for s in range(0, len(pair), 1 << 14):
        f, g = kinds[pair[s : s + (1 << 14)] // len(kinds)], kinds[pair[s : s + (1 << 14)] % len(kinds)]
        first[s : s + (1 << 14)] = ~((f[:, :, None] == g[:, None, :]) & (f >= 0)[:, :, None]).any(axis=(1, 2))
    first = first[at]
    sums = np.bincount(a[first], weight[b[first]], n) + np.bincount(b[first], weight[a[first]], n)
    return sums.astype(np.int64), root


_KEY = ["label", "f", "i", "j"]


def _dealt(member: DataFrame) -> DataFrame:
    """Rows (label, f, c, ...) dealt to pairs of blocks (i, j) of their filter; most filters are one block."""
    hot = member.groupBy("label", "f").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    hot = checkpointed(hot.select("label", "f", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")))
    few = hot.count() <= HOT_BROADCAST
    split = member.join(F.broadcast(hot) if few else hot, ["label", "f"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")
    return split.repartition(*_KEY).sortWithinPartitions(*_KEY, "c")


def links(classes: DataFrame, size: int, rows: int) -> DataFrame:
    """``classes(c, label, embedding, n)`` -> (c, links, root): partial link sums and forest edges, to be summed up."""
    label = dict(classes.dtypes)["label"]
    shared = classes.sparkSession.sparkContext.broadcast(Filters(size, rows))  # square root of the rows, times the size

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1 << 12):
                own = b.slice(at, 1 << 12)
                x = unit(matrix(own.column("embedding"), size))
                found, sketch = shared.value.decode(x), shared.value.sketch(x)
                row = np.repeat(np.arange(len(own)), found.shape[1])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own.column("c").take(take), own.column("label").take(take), pa.array(found.ravel(), pa.int64()), pa.array(sketch[row, 0]), pa.array(sketch[row, 1])],
                    ["c", "label", "f", "s1", "s2"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Who has another one within reach."""
        reach = shared.value.reach
        for t, starts, ends in runs(batches, _KEY):
            s1, s2, part = (t.column(k).to_numpy() for k in ("s1", "s2", "part"))
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # bits of negative numbers would count by absolute value
            found = np.zeros(len(t), bool)
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a < 2:
                    continue
                u, v, p = s1[a:b], s2[a:b], part[a:b]
                two = p.min() != p.max()
                for s in range(0, b - a, 512):
                    near = np.bitwise_count(u[s : s + 512, None] ^ u) + np.bitwise_count(v[s : s + 512, None] ^ v) <= reach
                    if two:
                        near &= p[s : s + 512, None] != p
                    found[a + s : min(b, a + s + 512)] = near.sum(axis=1) > (0 if two else 1)  # itself is near
            yield from t.select(["c", "label", "f"]).filter(pa.array(found)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, _KEY):
            ids, f, part, weight = (t.column(k).to_numpy() for k in ("c", "f", "part", "n"))
            out = []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a < 2:
                    continue
                x = unit(matrix(t.column("embedding").slice(a, b - a), size))
                got = _compare(x, weight[a:b], shared.value.decode(x), part[a:b], int(f[a]))
                if got is not None:
                    some = np.flatnonzero((got[0] > 0) | (got[1] != np.arange(b - a)))
                    out.append((ids[a:b][some], got[0][some], ids[a:b][got[1]][some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], ["c", "links", "root"])

    member = classes.select("c", "label", "embedding").mapInArrow(decode, f"c long, label {label}, f long, s1 long, s2 long")
    near = checkpointed(_dealt(member).mapInArrow(meet, f"c long, label {label}, f long").distinct())
    body = near.join(classes.select("c", "n", "embedding"), "c")
    return _dealt(body).mapInArrow(verify, "c long, links long, root long")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, embedding, label)`` -> (vec_id, n_links, component_id, kept), one row per input row."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    mine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", fine.alias("fine"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    alone = mine.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # a class is named by 128 bits of its vector, so that the vectors themselves are shuffled once
    name = ["label", "h1", "h2"]
    used = mine.where("fine").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), F.reverse("embedding"))})
    classes = used.groupBy(*name).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = checkpointed(classes.withColumn("c", F.monotonically_increasing_id()))
    found = [links(classes.where(F.size("embedding") == size), size, n) for size, n in sizes(classes)]
    if not found:
        return alone.withColumn("kept", kept)
    found = checkpointed(reduce(DataFrame.unionByName, found))
    parts = connected_components(found.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "c")
    near = found.groupBy("c").agg(F.sum("links").alias("links"))
    whole = classes.select("c", *name, "least", "n").join(near, "c", "left").join(parts, "c", "left")
    whole = whole.withColumn("component", F.coalesce("component", "c"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "component").select(*name, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = used.select("vec_id", *name).join(whole, name).select("vec_id", "n_links", "component_id")
    return done.unionByName(alone).withColumn("kept", kept)


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
