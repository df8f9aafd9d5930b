"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within radius 2 are both within 1 bit of some common value, so each distinct
fingerprint emits itself and its 64 one-bit variants (half the radius), the variants are shuffled, and
fingerprints that meet on a variant are linked.  All members of such a bucket lie within 1 bit of the variant
(at most 65 distinct fingerprints), so linking each to the bucket's smallest loses no connection; every
emitted link is verified by its Hamming distance.  Copies share a fingerprint and are collapsed before that.

Edge cases: a null, empty or blank text has fingerprint 0 and links like any other; a text of one or two words
is a single shingle; repeated rows share their component; a null doc_id never becomes a component id unless
its whole group has none (then null).  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, shuffle_partitions, strings, table, tidy
from .graph import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    last = (ends - 1)[shingle - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # blocks: memory stays bounded for very long texts
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    def batch(text: pa.Array) -> pa.Array:
        values = np.fromiter((simhash64(t, shingle) for t in strings(text)), np.uint64, len(text))
        tidy()
        return pa.array(values.view(np.int64))

    return F.arrow_udf(batch, "long")(text)


def _links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps(fp)`` distinct -> verified links (u, v) that connect all fingerprints within an even radius.

    Members of one variant's bucket are within half the radius of it, so within the radius of each other."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: half of it is hashed")
    masks = [sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    spread = fps.repartition(shuffle_partitions(fps.sparkSession), "fp")  # few bytes that become 65 times as many
    balls = spread.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = balls.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius).select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints(doc_id, fp)`` -> one row per distinct fp: (fp, group = smallest fp reachable, component_id)."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(_links(fps.select("fp"), radius))
    grouped = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("grp"))
    ids = grouped.groupBy("grp").agg(F.min("first_id").alias("component_id"))
    return grouped.join(ids, "grp").select("fp", "grp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, fingerprint, component_id), one row per input row."""
    prints = checkpointed(docs.select("doc_id", simhash(F.col("text"), shingle).alias("fp")))
    return prints.join(fingerprint_groups(prints, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies, columns as they came.

    Of each group the document with the smallest doc_id stays: one row, also if rows repeat (of several texts
    under that id, the one of smallest hash); a group of null ids keeps one of its texts.  Survivors are found
    among small rows; texts are shuffled once, by (doc_id, text hash)."""
    d, th = F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64("text")
    prints = checkpointed(docs.select("doc_id", d.alias("d"), th.alias("th"), simhash(F.col("text"), shingle).alias("fp")))
    joined = prints.join(fingerprint_groups(prints, radius), "fp").where(F.col("d") == F.coalesce("component_id", F.lit(NO_ID)))
    stay = joined.groupBy("grp").agg(F.min("d").alias("d"), F.min("th").alias("th")).select("d", "th")
    rows = docs.select(F.struct("*").alias("row"), d.alias("d"), th.alias("th"))
    return rows.join(stay, ["d", "th"], "left_semi").dropDuplicates(["d", "th"]).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
