"""Edit mining and repair candidates as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import edits


def context_edits(pairs: DataFrame, broken: str = "broken", fixed: str = "fixed") -> DataFrame:
    """Token arrays -> one row per edit (kind, left, old, right, new), contexts padded with BOS and EOS."""
    e = pairs.select(F.col(broken).alias("b"), F.explode(edits(F.col(broken), F.col(fixed))).alias("e"))
    at = F.col("e.pos")
    right = F.when(F.col("e.kind") == "INS", at + 1).otherwise(at + 2)
    return e.select(
        F.col("e.kind").alias("kind"), F.when(at == 0, F.lit("BOS")).otherwise(F.get("b", at - 1)).alias("left"), F.col("e.old").alias("old"),
        F.coalesce(F.get("b", right - 1), F.lit("EOS")).alias("right"), F.col("e.new").alias("new"))


def edit_counts(pairs: DataFrame) -> DataFrame:
    return context_edits(pairs).groupBy("kind", "left", "old", "right", "new").agg(F.count(F.lit(1)).alias("n"))


def relevant_edits(tokens: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """All edits of a (left, old, right, new, n) table that apply at some trigram of (key, w)."""
    padded = tokens.select(key, F.concat(F.array(F.lit("BOS")), "w", F.array(F.lit("EOS"))).alias("p"))
    grams = padded.where(F.size("p") >= 3).select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(
        F.get("p", i - 1).alias("left"), F.get("p", i).alias("old"), F.get("p", i + 1).alias("right")))).alias("pos", "g")).select(key, "pos", "g.*")
    return grams.join(table, ["left", "old", "right"])


def candidates(broken: DataFrame, fillers: DataFrame, key: str = "id") -> DataFrame:
    """Single-edit candidates (key, kind, pos, new, candidate): every deletion, and each filler inserted or substituted at every position."""
    rows = broken.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    head, size = F.slice("w", 1, F.col("pos")), F.size("w")
    tail = lambda skip: F.slice("w", F.col("pos") + 1 + skip, F.greatest(size - F.col("pos") - skip, F.lit(0)))
    drop = rows.where(F.col("pos") < size).select(key, F.lit("DEL").alias("kind"), "pos", F.lit("").alias("new"), F.concat(head, tail(1)).alias("candidate"))
    filled = rows.crossJoin(F.broadcast(fillers.select("new")))  # fillers: the caller's bounded dictionary
    put = filled.select(key, F.lit("INS").alias("kind"), "pos", "new", F.concat(head, F.array("new"), tail(0)).alias("candidate"))
    swap = filled.where((F.col("pos") < size) & (F.get("w", F.col("pos")) != F.col("new"))).select(key, F.lit("SUB").alias("kind"), "pos", "new", F.concat(head, F.array("new"), tail(1)).alias("candidate"))
    return drop.unionByName(put).unionByName(swap)


def ranked(scored: DataFrame, key: str = "id") -> DataFrame:
    """Distinct candidates by (edits, score), best first, 0-based rank."""
    best = scored.groupBy(key, "candidate").agg(F.min("edits").alias("edits"), F.min("score").alias("score"))
    return best.withColumn("rank0", F.row_number().over(Window.partitionBy(key).orderBy("edits", "score", F.array_join("candidate", " "))) - 1)


def rank_of_truth(candidates_ranked: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """(key, rank0) of the true candidate, -1 if it is absent."""
    hit = candidates_ranked.join(truth.select(key, F.col("truth").alias("candidate")), [key, "candidate"]).select(key, "rank0")
    return truth.select(key).join(hit, key, "left").withColumn("rank0", F.coalesce("rank0", F.lit(-1)))


def insertion_ranks(items: DataFrame, at: Column) -> DataFrame:
    """``items(id, truth)``, the truth's word at a 0-based place being lost -> (id, rank0) of the truth among all distinct insertions
    of one word of the vocabulary (all words of all truths): frequent words first, then by word, then by place.

    Nothing is enumerated: a word v can be put back in size + 1 ways less one for each v already there, so the candidates
    of the words before the lost one are a product less a count of the item's words that come before it."""
    rows = items.select("id", "truth", at.alias("at")).select("id", "at", F.get("truth", F.col("at")).alias("lost"), F.concat(F.slice("truth", F.lit(1), F.col("at")), F.slice("truth", F.col("at") + 2, F.size("truth"))).alias("w"))
    n = items.select(F.explode("truth").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # the vocabulary's order in two levels: totals of equal counts, then words inside one count
    sizes = n.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    sizes = sizes.withColumn("before", F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))  # one row a count
    order = n.withColumn("inside", F.row_number().over(Window.partitionBy("n").orderBy("word")) - 1).join(sizes.select("n", "before"), "n").select("word", (F.col("before") + F.col("inside")).alias("place"))
    rows = rows.join(order.withColumnRenamed("word", "lost"), "lost")
    own = rows.select("id", F.col("place").alias("lost_place"), F.explode("w").alias("word")).join(order, "word").where(F.col("place") < F.col("lost_place")).groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    fresh = F.filter(F.sequence(F.lit(0), F.size("w")), lambda p: (p == 0) | (F.get("w", p - 1) != F.col("lost")))  # insertions that differ
    ways = F.size(F.filter(fresh, lambda p: p <= F.col("at"))) - 1
    return rows.join(own, "id", "left").select("id", (F.col("place") * (F.size("w") + 1) - F.coalesce("own", F.lit(0)) + ways).alias("rank0"))
