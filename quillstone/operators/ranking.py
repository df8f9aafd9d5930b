"""Evaluation tables over trials of ranked candidates: precision by bucket and by time, rank statistics, densities, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import running

EVERY = 1 << 62  # as a cut: all ranks


def _when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def precision_by_bucket(trials: DataFrame, n: int, by: list[Column]) -> DataFrame:
    """By the given columns: trials with a rank under n, with a later one, and without one (-1); precision pos / (pos + high + neg + 1)."""
    r = F.col("rank0")
    out = trials.groupBy(*by).agg(_when((r >= 0) & (r < n)).alias("pos"), _when(r >= n).alias("high"), _when(r < 0).alias("neg"))
    return out.withColumn("precision", F.round(F.col("pos") / (F.col("pos") + F.col("high") + F.col("neg") + 1), 6))


def precision_by_time(trials: DataFrame, ks: tuple[int, ...] = (1, 5, 10, EVERY), most: int = 9000, step: int = 1000) -> DataFrame:
    """(k, cut, hits, precision): trials that have a rank under k before each time cut, over all trials.

    Trials fall into one time step each, and the steps' counts are summed up: no trial meets every cut."""
    total = trials.agg(F.count(F.lit(1)).alias("total"))
    steps = trials.where((F.col("rank0") >= 0) & (F.col("ms") < most)).groupBy((F.floor(F.greatest("ms", F.lit(0)) / step) * step + step).alias("cut"), "rank0").agg(F.count(F.lit(1)).alias("n"))
    spark = trials.sparkSession
    grid = spark.createDataFrame([(k, c) for k in ks for c in range(step, most + 1, step)], "k long, cut long")
    level = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in ks]), lambda k: F.col("rank0") < k)).alias("k")
    hits = steps.select("cut", "n", level).groupBy("k", "cut").agg(F.sum("n").alias("n"))
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("k").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(hits, ["k", "cut"], "left").withColumn("hits", run).crossJoin(F.broadcast(total)).select(
        "k", "cut", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("precision"))  # one row


def rank_statistics(proposals: DataFrame, limits: list[int], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``proposals(sample, place, ms, hit)`` -> by time limit: MRR of the first hit among the proposals made in time, and
    the mean number of hits among the first k and among all of them.  A sample without a proposal in time counts 0."""
    samples = proposals.agg(F.countDistinct("sample").alias("samples"))
    timed = proposals.select("sample", "place", "ms", "hit", F.explode(F.filter(F.array(*[F.lit(t).cast("long") for t in limits]), lambda t: F.col("ms") <= t)).alias("limit_ms"))
    timed = timed.withColumn("nth", F.row_number().over(Window.partitionBy("sample", "limit_ms").orderBy("place")))
    each = timed.groupBy("sample", "limit_ms").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("nth"))), F.lit(0.0)).alias("rr"), _when(F.col("hit")).alias("all"), *[_when(F.col("hit") & (F.col("nth") <= k)).alias(f"h{k}") for k in ks])
    out = each.groupBy("limit_ms").agg(F.sum("rr").alias("rr"), F.sum("all").alias("all"), *[F.sum(f"h{k}").alias(f"h{k}") for k in ks]).crossJoin(F.broadcast(samples))  # one row
    share = lambda c: F.round(F.col(c) / F.col("samples"), 6)
    return out.select("limit_ms", share("rr").alias("mrr"), *[share(f"h{k}").alias(f"p_at_{k}") for k in ks], share("all").alias("p_at_all"))


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient of a column over a small number."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / F.lit(float(i + 1))
    return out


def search_space(n: Column, k: Column, vocabulary: int, most: int = 5) -> Column:
    """Size of the space of up to k edits of n tokens: the sum over c of C(c n + n + 1, c) (vocabulary + 1)^c."""
    out = F.lit(0.0)
    for c in range(1, most + 1):
        out = out + F.when(k >= c, choose(c * n + n + 1, c) * float((vocabulary + 1) ** c)).otherwise(0.0)
    return out


def densities(repairs: DataFrame, vocabulary: int) -> DataFrame:
    """``repairs(sample, length, edits)`` -> (sample, length, radius, admits, at_radius, density): share of the search space that was valid."""
    out = repairs.groupBy("sample").agg(F.max("length").alias("length"), F.max("edits").alias("radius"), F.count(F.lit(1)).alias("admits"))
    last = repairs.join(out.select("sample", "radius"), "sample").groupBy("sample").agg(_when(F.col("edits") == F.col("radius")).alias("at_radius"))
    return out.join(last, "sample").withColumn("density", F.col("admits") / search_space(F.col("length"), F.col("radius"), vocabulary))


def counters(trials: DataFrame, *by: Column) -> DataFrame:
    """(by, top1, recall, pos, total, errors): successes at the first rank, at any, without failure; all trials; failures."""
    r = F.col("rank0")
    return trials.groupBy(*by).agg(_when(r == 0).alias("top1"), _when(r >= 0).alias("recall"), _when((r >= 0) & ~F.col("failed")).alias("pos"), F.count(F.lit(1)).alias("total"), _when(F.col("failed")).alias("errors"))


def attempt_averages(trials: DataFrame, limit: int, *by: str) -> DataFrame:
    """Means over trials that succeeded within the limit and those that expired: time, rank, candidates a second."""
    done, late = (F.col("rank0") >= 0) & (F.col("ms") < limit), F.col("ms") >= limit
    mean = lambda c, x: F.round(F.avg(F.when(c, x)), 6)
    return trials.groupBy(*by).agg(
        _when(done).alias("succeeded"), mean(done, F.col("ms")).alias("ms"), mean(done, F.col("rank0")).alias("rank"),
        mean(done, F.col("length") * 1000.0 / (F.col("ms") + 1)).alias("throughput"), _when(late).alias("expired"), mean(late, F.col("ms")).alias("expired_ms"))


def running_mean(df: DataFrame, group: str, order: str, value: Column, block: Column, digits: int = 6) -> DataFrame:
    """Running mean of an integer value along the order, in blocks (``stats.running``), as column ``mean``."""
    out = running(df, group, block, [F.col(order)], {"_total": value, "_n": F.lit(1)})
    return out.withColumn("mean", F.round(F.col("_total") / F.col("_n"), digits)).drop("_total", "_n")


def distance_agreement(pairs: DataFrame, strings: str, vectors: str) -> DataFrame:
    """``pairs`` of two distances -> by hundredths of the first: number, mean and population variance of the second."""
    return pairs.groupBy(F.floor(F.col(strings) * 100).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(vectors), 6).alias("mean"), F.round(F.var_pop(vectors), 6).alias("var"))


def score_histogram(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, scores map value -> count): all scores of a cell of the table, equal ones counted, so that a cell stays small."""
    n = scores.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias("scores"))


def starts_the_truth(predictions: Column, truth: Column) -> Column:
    """1 if any of the predictions, trimmed, begins the truth, else 0; an empty prediction begins everything."""
    return F.coalesce(F.exists(predictions, lambda p: F.startswith(truth, F.trim(p))), F.lit(False)).cast("int")


def argmax(values: Column) -> Column:
    """0-based place of the first largest value; -1 for an empty array."""
    return F.coalesce(F.array_position(values, F.array_max(values)) - 1, F.lit(-1))


def blanket(edits: DataFrame) -> DataFrame:
    """``edits(sample, pos)`` -> (sample, positions): how many places any valid repair touches."""
    return edits.groupBy("sample").agg(F.countDistinct("pos").alias("positions"))
