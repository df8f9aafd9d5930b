"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Only DataFrame joins and aggregates; each round is checkpointed, so lineage stays short and a lost executor
costs at most the round it was in.  No node's neighbours are ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge has u > v here; link all smaller neighbours of u, and u, to the smallest one
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``, component being the smallest node reachable.

    Self loops, repeated edges and either direction are fine; edges with a null end are ignored.  No edges give
    an empty result.  Nodes without an edge do not appear.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = checkpointed(e.distinct())
    state = _state(e)
    if state[0]:
        for _ in range(max_rounds):
            e = checkpointed(_small_star(_large_star(e)))
            now = _state(e)
            if now == state:
                break
            state = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
