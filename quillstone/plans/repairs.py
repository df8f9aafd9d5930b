"""Edit mining and repair queries over adjacent benchmark items and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences, text as X
from ..operators import edits, relalg, stats
from ..sources.corpus import table


def _pairs(spark, sf):
    """The words of each benchmark item and the next item's."""
    b = table(spark, sf, "benchmark").select("item_id", X.words(F.lower("text")).alias("w"))
    return b.select(F.col("item_id").alias("id"), F.col("w").alias("broken")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("w").alias("fixed")), "id")


def patch_kinds(spark, sf):
    return edits.context_edits(_pairs(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def patch_trigrams(spark, sf):
    return edits.edit_counts(_pairs(spark, sf)).orderBy(F.desc("n"), "kind", "left", "old", "right", "new").limit(100)


def lcs_rerank(spark, sf):
    return _pairs(spark, sf).select("id", F.round(sequences.lcs_distance(F.col("broken"), F.col("fixed")), 6).alias("dist"))


def edit_location_hist(spark, sf):
    """Tenths of the text at which its edits lie; an insertion at the end counts to the last tenth."""
    e = _pairs(spark, sf).select(F.size("broken").alias("n"), F.explode(sequences.edits(F.col("broken"), F.col("fixed"))).alias("e"))
    return e.groupBy(F.least(F.floor(F.col("e.pos") * 10 / F.greatest("n", F.lit(1))), F.lit(9)).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


def edit_gaps(spark, sf):
    """Distances between consecutive edits of a pair, with their shares."""
    at = F.transform(sequences.edits(F.col("broken"), F.col("fixed")), lambda e: e["pos"])
    e = _pairs(spark, sf).select(F.explode(F.array(at)).alias("at"))  # the array behind a generator: aligned once
    gaps = e.where(F.size("at") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.get("at", i) - F.get("at", i - 1))).alias("gap"))
    return stats.relative_frequency(gaps, "gap", 6)


def edit_distance_cdf(spark, sf):
    """Cumulative distribution of the pairs' token edit distances, in tens."""
    return stats.cumulative(_pairs(spark, sf), X.bucket10(F.size(sequences.edits(F.col("broken"), F.col("fixed")))))


def applicable_edits(spark, sf):
    """Mined edits that apply somewhere in each item, by number of places."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.words(F.lower("text")).alias("w"))
    return edits.relevant_edits(items, edits.edit_counts(_pairs(spark, sf))).groupBy("id").agg(F.count(F.lit(1)).alias("places"))


def repair_rank(spark, sf):
    """The middle word of each item is dropped; candidates put any word of the vocabulary back anywhere, frequent words first,
    then by word and place; rank of the truth: MRR and P@k."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.words(F.lower("text")).alias("truth")).where(F.size("truth") >= 2)
    return stats.ranking_metrics(edits.insertion_ranks(b, F.floor(F.size("truth") / 2).cast("int")), "rank0", (1, 10, 100, 1000))


def link_closure(spark, sf):
    """Pages' language sections reachable over the hosts they share, up to three steps."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("src"), F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("dst")).where("src <> '' and dst <> ''").distinct()
    both = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return relalg.closure(both, 3)


QUERIES = {f.__name__: f for f in (patch_kinds, patch_trigrams, lcs_rerank, edit_location_hist, edit_gaps, edit_distance_cdf, applicable_edits, repair_rank, link_closure)}
ORACLE_SQL = {
    "repair_rank": r"""WITH b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '\w+') AS t FROM benchmark WHERE len(regexp_extract_all(lower(text), '\w+')) >= 2),
        v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM (SELECT unnest(t) AS w FROM b) GROUP BY w),
        k AS (SELECT id, t[len(t) // 2 + 1] AS word, t[1:len(t) // 2] || t[len(t) // 2 + 2:len(t)] AS x, len(t) // 2 AS mid FROM b),
        q AS (SELECT k.*, r FROM k JOIN v ON v.w = k.word), o AS (SELECT id, unnest(x) AS w FROM q), bf AS (SELECT o.id, count(*) AS n FROM o JOIN v USING (w) JOIN q ON q.id = o.id WHERE v.r < q.r GROUP BY o.id),
        p AS (SELECT id, word, x, mid, unnest(range(0, len(x) + 1)) AS p FROM q), d AS (SELECT *, p > 0 AND x[p] = word AS dup FROM p),
        c AS (SELECT id, any_value(mid) AS mid, max(p) FILTER (WHERE NOT dup AND p <= mid) AS canon FROM d GROUP BY id), pl AS (SELECT d.id, count(*) FILTER (WHERE NOT dup AND p < canon) AS before FROM d JOIN c USING (id) GROUP BY d.id),
        z AS (SELECT (q.r - 1) * (len(q.x) + 1) - coalesce(bf.n, 0) + pl.before AS rk FROM q LEFT JOIN bf USING (id) JOIN pl USING (id))
        SELECT count(*) AS n, round(avg(1.0::DOUBLE / (rk + 1)), 6) AS mrr, round(avg(CASE WHEN rk < 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_1, round(avg(CASE WHEN rk < 10 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_10,
          round(avg(CASE WHEN rk < 100 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_100, round(avg(CASE WHEN rk < 1000 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_1000 FROM z""",
    "link_closure": r"""WITH RECURSIVE p AS (SELECT DISTINCT regexp_extract(url, '\.([a-z]+)/', 1) AS src, regexp_extract(url, '/([a-z]{2})/', 1) AS dst FROM pages),
        e AS (SELECT * FROM p WHERE src <> '' AND dst <> '' UNION SELECT dst, src FROM p WHERE src <> '' AND dst <> ''),
        c AS (SELECT src, dst, 1 AS h FROM e UNION SELECT c.src, e.dst, h + 1 FROM c JOIN e ON c.dst = e.src WHERE h < 3)
        SELECT DISTINCT src, dst FROM c""",
}
