"""Mixing sources to target weights by systematic sampling.

Sizes are words.  Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ...; their targets share all
words by weight, no target above three times its source's size, the excess reshared by weight until none is
above (the closed form of that: targets min(3 size, level * weight) with one common level).  A source's
documents have equal expected copies, target / source size; ordered by (size, hash, id), their prefix sums plus
one random offset per source cross an integer once for each copy.  The hash is of id and text.  Sorting by size makes the sample follow the
size distribution, so the words taken come near the target.

Ranks come without one task per source: totals by (source, size) give the first rank of each size, counts by
hash prefix give the first rank in a size, and only rows of one (source, size, prefix) are sorted together; the
prefix is as long as the largest group needs.

Edge cases: a null or empty text has size 0 and is emitted like any other (its copies add no words); rows that
repeat are ranked next to each other, null ids first; an all-empty source has target 0 and no copies; an empty
table gives an empty result; names are taken from docs, columns travel in one struct, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Rows that are sorted together, about.
GROUP = 2_000
_KEYS = ["_null", "_source", "_size"]


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns as a struct, beside the keys; the order's hash takes the text in, so that null or equal ids spread."""
    name = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("_id"), F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), word_count(F.col("text")).alias("_size"), F.md5(name).alias("_hash"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(_null, _source, words)`` one row per source -> plus weight, target, rate, start (the random offset).

    One row per source, so the windows below sort a small table; sums are of integers, exact in any order."""
    order = Window.orderBy("_null", "_source")
    s = sizes.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight)
    # by rising ratio of cap to weight: the sources at their cap are a prefix
    by_ratio = Window.orderBy(F.col("words") / F.col("weight"), "_i")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({
        "_capped": F.coalesce(F.sum("words").over(before), F.lit(0)), "_open": F.sum("weight").over(rest),
        "_all": F.sum("words").over(Window.partitionBy()),
    })
    s = s.withColumn("_level", (F.col("_all") - MOST * F.col("_capped")) / F.col("_open"))
    # the first source that stays below its cap at its level sets the level of all after it
    below = F.col("_level") * F.col("weight") <= MOST * F.col("words")
    s = s.withColumn("_level", F.first(F.when(below, F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("_level") * F.col("weight"), (MOST * F.col("words")).cast("double")), (MOST * F.col("words")).cast("double"))
    seed = F.concat(F.lit(SEED), F.when(F.col("_null"), F.lit("0")).otherwise(F.lit("1")), F.col("_source"))
    start = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return s.withColumn("target", target).select(
        "_null", "_source", F.col("words").alias("source_size"), "weight", "target",
        F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0).alias("rate"), start.alias("start"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row = the document's kept columns as a struct, size long, source_size long, target double, copies long from 0 to 3).

    Only kept columns are shuffled with the keys: leave the text out where it isn't needed."""
    rows = _keyed(docs, docs.columns if keep is None else keep)
    sizes = checkpointed(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")))  # light: read twice below
    sources = sizes.groupBy("_null", "_source").agg(F.sum(F.col("_size") * F.col("n")).alias("words"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    width = 0
    while most > GROUP * 16**width and width < 6:
        width += 1
    part = F.substring("_hash", 1, width) if width else F.lit("")
    ranked = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("_null", "_source").orderBy("_size")) - F.col("n"))
    keys = _KEYS
    if width:
        parts = rows.groupBy(*_KEYS, part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
        inner = F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("_part")) - F.col("n")
        ranked = ranked.drop("n").join(parts.withColumn("_inner", inner), _KEYS).withColumn("_before", F.col("_before") + F.col("_inner")).drop("_inner", "n")
        keys = [*_KEYS, "_part"]
        rows = rows.withColumn("_part", part)
    else:
        ranked = ranked.drop("n")
    plan = ranked.join(source_targets(sources), ["_null", "_source"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", "_id")) + F.col("_before")
    out = rows.join(plan, keys).withColumn("_rank", rank.cast("double"))
    crossed = F.floor(F.col("start") + F.col("rate") * F.col("_rank")) - F.floor(F.col("start") + F.col("rate") * (F.col("_rank") - 1.0))
    return out.select("row", F.col("_size").alias("size"), "source_size", "target", crossed.cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document once per copy, columns as they came."""
    out = mix(docs).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "row.source", "copies")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, source IS NULL AS nul, coalesce(source, '') AS s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS h FROM documents),
src AS (SELECT nul, s, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY nul, s) - 1 AS i FROM d GROUP BY nul, s),
wt AS (SELECT *, 1 + i % 3 AS w FROM src),
lv AS (SELECT *, (SELECT sum(words) FROM src) AS total,
    coalesce(sum(words) OVER (ORDER BY words / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY words / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM wt),
ll AS (SELECT *, CAST(total - 3 * capped AS DOUBLE) / CAST(open AS DOUBLE) AS lev FROM lv),
lt AS (SELECT max(lev) FILTER (WHERE lev * w <= 3 * words) AS level FROM ll),
tg AS (SELECT nul, s, words, least(level * w, CAST(3 * words AS DOUBLE)) AS target,
    CAST(('0x' || substr(md5('mix-1' || CASE WHEN nul THEN '0' ELSE '1' END || s), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM ll, lt),
rk AS (SELECT d.*, words, target, start, CASE WHEN words > 0 THEN target / words ELSE 0.0 END AS rate,
    CAST(row_number() OVER (PARTITION BY d.nul, d.s ORDER BY size, h, doc_id NULLS FIRST) AS DOUBLE) AS r FROM d JOIN tg ON d.nul = tg.nul AND d.s = tg.s),
cp AS (SELECT *, CAST(floor(start + rate * r) - floor(start + rate * (r - 1.0)) AS BIGINT) AS copies FROM rk)
SELECT doc_id, size, words AS source_size, target, copies * size AS taken, source, copies FROM cp
"""
