"""Relational algebra: nest joins, first-match joins, positional and total joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def not_null(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(subset=list(names))


def nest_join(left: DataFrame, right: DataFrame, on: str, value: str, into: str = "matches") -> DataFrame:
    """Each left row with the sorted list of its matches; [] without one.  The right side is nested before the join."""
    nested = right.where(F.col(value).isNotNull()).groupBy(on).agg(F.array_sort(F.collect_list(value)).alias(into))
    out = left.join(nested, on, "left")
    return out.withColumn(into, F.coalesce(into, F.array().cast(out.schema[into].dataType)))


def first_match(right: DataFrame, on: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return right.withColumn("_nth", F.row_number().over(Window.partitionBy(on).orderBy(*order))).where("_nth = 1").drop("_nth")


def left_join_first(left: DataFrame, right: DataFrame, on: str, *order: Column) -> DataFrame:
    return left.join(first_match(right, on, *order), on, "left")


def inner_join_first(left: DataFrame, right: DataFrame, on: str, *order: Column) -> DataFrame:
    return left.join(first_match(right, on, *order), on)


def zip_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Join by stored ordinal; the shorter side decides."""
    return left.join(right, F.col(left_order) == F.col(right_order))


def total_lookup(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Inner join that fails on a key without a match."""
    out = left.join(right, on, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.raise_error(F.concat(F.lit("no match for "), F.col(on).cast("string")))))


def membership_split(df: DataFrame, members: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is a member, rows whose key isn't)."""
    return df.join(members, on, "left_semi"), df.join(members, on, "left_anti")


def closure(edges: DataFrame, max_height: int = 10) -> DataFrame:
    """Transitive closure (src, dst) of up to max_height steps; each round joins only the newest pairs."""
    edges = found = newest = cut(edges.select("src", "dst").distinct())
    for _ in range(max_height - 1):
        step = newest.withColumnRenamed("dst", "mid").join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        newest = cut(step.join(found, ["src", "dst"], "left_anti"))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return found
