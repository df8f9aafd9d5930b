"""Distributions, agreement of distances, running histograms, sampled draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coding, text as X
from ..functions.sequences import edits as aligned
from ..functions.sequences import lcs_distance
from ..operators import edits, markov, stats, vecindex
from ..sources.corpus import table, with_tokens
from .repairs import _pairs
from .scores import trials


def significant(x, digits: int = 5):
    """Rounded to so many significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / unit) * unit)


def decimal_statistics(spark, sf):
    """Mean and population variance of order totals by priority, to five significant digits."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.var_pop("o_totalprice").alias("v"))
    return o.select("o_orderpriority", F.round(significant(F.col("m")), 3).alias("mean"), F.round(significant(F.col("v")), 3).alias("var"))


def slice_correlation(spark, sf):
    """Correlation of the edit distance of two items with the distance of their vectors in two neighbouring dimensions, by dimension."""
    b = table(spark, sf, "benchmark").select("item_id", X.visible_chars(F.col("text")).alias("t")).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    both = b.join(b.select(F.col("item_id").alias("j"), F.col("t").alias("u"), F.col("embedding").alias("e")), F.col("item_id") < F.col("j"))
    both = both.select(F.levenshtein("t", "u").cast("double").alias("s"), F.zip_with("embedding", "e", lambda x, y: x.cast("double") - y).alias("d"))
    each = both.select("s", F.posexplode(F.zip_with(F.slice("d", F.lit(1), F.size("d") - 1), F.slice("d", F.lit(2), F.size("d") - 1), lambda x, y: F.sqrt(x * x + y * y))).alias("dim", "v"))
    return each.groupBy("dim").agg(F.round(F.corr("s", "v"), 6).alias("r"))


def host_line_stats(spark, sf):
    """Hosts as repositories: licences, pages, lines (code lines twice), code lines, code lines times the host's supertypes."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), X.license_class(F.col("html")).alias("license"), F.split("html", "\n", -1).alias("l"))
    p = p.select("host", "license", F.size("l").alias("lines"), F.size(F.filter("l", lambda x: ~X.is_comment_or_empty(x))).alias("holes"), (F.size(F.split("host", "[.]", -1)) - 1).alias("above"))
    return p.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("license")), "/").alias("licenses"), F.count(F.lit(1)).alias("files"), F.sum(F.col("lines") + F.col("holes")).alias("lines"),
                                 F.sum("holes").alias("holes"), F.sum(F.col("holes") * F.col("above")).alias("weighted"))


def bigrams_across_texts(spark, sf):
    """The commonest neighbouring words of all documents read one after the other, borders of documents included.

    The next document with a word is found inside blocks of ids, and between blocks among one row a block."""
    d = with_tokens(table(spark, sf, "documents"), X.words(F.col("text")), "doc_id").where(F.size("w") > 0)
    inner = d.select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram"))
    ends = d.select("doc_id", F.floor(F.col("doc_id") / 8192).alias("block"), F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"))
    inside = Window.partitionBy("block").orderBy("doc_id")
    ends = ends.withColumn("next", F.lead("first").over(inside))
    edges = ends.groupBy("block").agg(F.min_by("first", "doc_id").alias("first"))
    edges = edges.select("block", F.lead("first").over(Window.orderBy("block")).alias("after"))  # one row a block of 8192 documents
    border = ends.join(edges, "block").select(F.concat_ws(" ", "last", F.coalesce("next", "after")).alias("gram")).where(F.contains("gram", F.lit(" ")))
    return inner.unionByName(border).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(100)


def reverse_patch_trigrams(spark, sf):
    """Context edits that turn each item back into the one before it."""
    p = _pairs(spark, sf).select(F.col("fixed").alias("broken"), F.col("broken").alias("fixed"))
    return edits.edit_counts(p).orderBy(F.desc("n"), "kind", "left", "old", "right", "new").limit(100)


def patch_size_cdf(spark, sf):
    return stats.cumulative(_pairs(spark, sf), F.size(aligned(F.col("broken"), F.col("fixed"))).cast("long"))


def hits_by_bin_and_type(spark, sf):
    """Share of events over 50 by user decade and event type, whatever types there are."""
    e = table(spark, sf, "events").groupBy(X.bin10(F.col("user_id")).alias("bin"), "event_type")
    return e.agg(F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("share"))


def hint_mrr(spark, sf):
    """Mean reciprocal rank of each turn's second word among the 20 commonest successors of its first, by role; absent counts 0."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text")), "role").select("role", X.ngrams(F.col("w"), 2).alias("g"))
    n = t.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("ctx", F.substring_index("gram", " ", 1))
    hints = n.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("n"), "gram"))).where("rank <= 20").select("gram", "rank")
    first = t.where(F.size("g") > 0).select("role", F.get("g", F.lit(0)).alias("gram"))
    return first.join(hints, "gram", "left").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def nearest_as_classifier(spark, sf):
    """For every hundredth vector: the 30 nearest are positives, the 100 furthest negatives, and half-way between their mean
    distances is the border; of the next 100 nearest and the 100 before the negatives, precision and recall of what lies inside."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    d = vecindex.nearest_and_furthest(e, e.where("vec_id % 100 = 0"), 130, 200)  # no other rank is asked for
    up, down = (Window.partitionBy("query_id").orderBy(*o) for o in ((F.asc_nulls_last("dist"), F.asc("vec_id")), (F.desc_nulls_last("dist"), F.desc("vec_id"))))
    r = d.withColumns({"near": F.row_number().over(up), "far": F.row_number().over(down)})
    border = r.groupBy("query_id").agg(((F.avg(F.when(F.col("near") <= 30, F.col("dist"))) + F.avg(F.when(F.col("far") <= 100, F.col("dist")))) / 2).alias("border"))
    test = r.join(border, "query_id").select("query_id", F.col("near").between(31, 130).alias("true"), F.col("far").between(101, 200).alias("false"), (F.col("dist") < F.col("border")).alias("inside")).where(F.col("true") | F.col("false"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = test.groupBy("query_id").agg(n(F.col("true") & F.col("inside")).alias("tp"), n(F.col("inside")).alias("retrieved"))
    return out.select("query_id", "tp", "retrieved", F.round(F.when(F.col("retrieved") > 0, F.col("tp") / F.col("retrieved")).otherwise(0.0), 6).alias("precision"), F.round(F.col("tp") / 100, 6).alias("recall"))


def position_errors(spark, sf):
    """Mean length of words and its standard error in 20 places of a text, from its beginning to its end."""
    w = with_tokens(table(spark, sf, "documents"), X.words(F.col("text"))).select(F.size("w").alias("n"), F.posexplode("w").alias("i", "t"))
    return w.groupBy(F.floor(F.col("i") / F.col("n") * 19).alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("t")), 6).alias("mean"), F.round(F.stddev_pop(F.length("t")) / F.sqrt(F.count(F.lit(1))), 6).alias("error"))


def running_histogram(spark, sf):
    """At each event, how many events of its value's tenth there were so far."""
    e = table(spark, sf, "events").select("event_id", F.least(F.floor(F.col("value") / 10), F.lit(9)).alias("tenth"))
    return stats.running(e, "tenth", F.floor(F.col("event_id") / 4096), [F.col("event_id")], {"so_far": F.lit(1)}).select("event_id", "tenth", "so_far")


def bonus_draws(spark, sf):
    """Two hundred draws of the commonest words, weighted by frequency times a bonus of at most five (the word's length)."""
    w = table(spark, sf, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(200)
    w = w.withColumn("weight", F.col("n") * F.least(F.length("word"), F.lit(5)))
    hi = F.sum("weight").over(Window.orderBy("word").rowsBetween(Window.unboundedPreceding, 0))  # 200 words
    w = w.select("word", (hi - F.col("weight")).alias("lo"), hi.alias("hi"), F.sum("weight").over(Window.partitionBy()).alias("total"))
    draws = spark.range(200).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat(F.lit("bonus-"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long").alias("u"))
    at = F.pmod("u", F.col("total"))
    return draws.join(F.broadcast(w), (at >= F.col("lo")) & (at < F.col("hi"))).select("draw", "word")


def chunk_chain(spark, sf):
    """Transitions of an order-2 chain over chunks of three characters, the commonest hundred."""
    text = X.visible_chars(F.col("text"))
    c = with_tokens(table(spark, sf, "benchmark"), F.regexp_extract_all(text, F.lit("..."), 0)).where(F.size("w") > 2)
    grams = c.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.concat(F.get("w", i), F.get("w", i + 1)).alias("ctx"), F.get("w", i + 2).alias("next")))).alias("g")).select("g.*")
    return markov.transitions(grams).select("ctx", "next", "n", "lo", "total").orderBy(F.desc("n"), "ctx", "next").limit(100)


def rank_rollup(spark, sf):
    """MRR and precision of trials by distance and over all."""
    r = F.col("rank0")
    t = trials(spark, sf).rollup("dist").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(r >= 0, 1.0 / (r + 1)).otherwise(0.0)), 6).alias("mrr"), *[F.round(F.avg(((r >= 0) & (r < k)).cast("double")), 6).alias(f"p_at_{k}") for k in (1, 5, 10)])
    return t


def balanced_trials(spark, sf):
    """As many trials of each distance as the rarest one has, by hash: how many, and how many of them found the truth."""
    t = trials(spark, sf).withColumn("h", F.md5(F.concat_ws("-", "sample", "dist", "l_partkey", "l_suppkey", "length")))
    b = stats.rebalanced(t.select("dist", "rank0", "h"), "dist", F.col("h"), F.col("rank0"))
    return b.groupBy("dist").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rank0") >= 0).cast("long")).alias("found"))


def role_distances(spark, sf):
    """Edit distance of each conversation's roles and the next one's, one character a token."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    c = c.select("conv_id", coding.charified(F.transform("t", lambda x: x["role"]), ["assistant", "system", "user"]).alias("c"))
    both = c.join(c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("c").alias("d")), "conv_id")
    return both.select("conv_id", F.levenshtein("c", "d").cast("long").alias("dist"))


def candidate_kinds(spark, sf):
    """How many single edits of each kind put one of the ten commonest words into each item, or take a word out."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.words(F.lower("text")).alias("w"))
    words = b.select(F.explode("w").alias("new")).groupBy("new").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "new").limit(10)
    return edits.candidates(b, words).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


def knn_text_rerank(spark, sf):
    """The 20 nearest vectors of every hundredth item's, by the longest common subsequence of the items' words, nearest ten."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")
    near = vecindex.knn(e, e.where("vec_id % 10 = 0"), 20)
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), X.words(F.lower("text")).alias("w"))
    both = near.join(t, "vec_id").join(t.select(F.col("vec_id").alias("query_id"), F.col("w").alias("v")), "query_id")
    scored = both.select("query_id", "vec_id", F.col("rank").alias("before"), F.round(lcs_distance(F.col("v"), F.col("w")), 6).alias("lcs"))
    w = Window.partitionBy("query_id").orderBy("lcs", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "vec_id", F.col("before").cast("long"), F.col("rank").cast("long"), "lcs")


_VIS = "regexp_replace(text, '[^!-~]', '', 'g')"
_SIG = "CASE WHEN %s = 0 THEN 0 ELSE round(%s / pow(10.0::DOUBLE, floor(log10(abs(%s))) - 4)) * pow(10.0::DOUBLE, floor(log10(abs(%s))) - 4) END"
_T = """t AS (SELECT l_orderkey AS sample, CAST(l_quantity AS BIGINT) AS length, CAST(l_linenumber AS BIGINT) AS dist, CASE WHEN l_suppkey % 5 = 0 THEN -1 ELSE l_partkey % 40 END AS rank0, l_partkey, l_suppkey FROM lineitem)"""
_COMMENT = "(length(trim(x)) <= 1 OR substr(trim(x), 1, 2) IN ('//', '* ', '/*'))"
QUERIES = {f.__name__: f for f in (
    decimal_statistics, slice_correlation, host_line_stats, bigrams_across_texts, reverse_patch_trigrams, patch_size_cdf, hits_by_bin_and_type, hint_mrr, nearest_as_classifier, position_errors,
    running_histogram, bonus_draws, chunk_chain, rank_rollup, balanced_trials, role_distances, candidate_kinds, knn_text_rerank)}
ORACLE_SQL = {
    "decimal_statistics": f"""WITH o AS (SELECT o_orderpriority, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1)
        SELECT o_orderpriority, round({_SIG % (('m',) * 4)}, 3) AS mean, round({_SIG % (('v',) * 4)}, 3) AS var FROM o""",
    "slice_correlation": f"""WITH b AS (SELECT item_id, {_VIS} AS t, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
        p AS (SELECT levenshtein(a.t, b.t)::DOUBLE AS s, a.e AS x, b.e AS y, unnest(range(0, len(a.e) - 1)) AS dim FROM b a JOIN b ON a.item_id < b.item_id)
        SELECT CAST(dim AS INTEGER) AS dim, round(corr(s, sqrt((x[dim + 1] - y[dim + 1]) * (x[dim + 1] - y[dim + 1]) + (x[dim + 2] - y[dim + 2]) * (x[dim + 2] - y[dim + 2]))), 6) AS r FROM p GROUP BY dim""",
    "host_line_stats": f"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, CASE WHEN contains(html, 'Apache ') THEN 'Apache' WHEN contains(html, 'GPL ') THEN 'GPL' WHEN contains(html, 'MIT license') THEN 'MIT'
          WHEN contains(html, 'Copyright (') THEN 'Custom' ELSE '?' END AS license, len(string_split(html, chr(10))) AS lines, len(list_filter(string_split(html, chr(10)), lambda x: NOT {_COMMENT})) AS holes FROM pages)
        SELECT host, string_agg(DISTINCT license, '/' ORDER BY license) AS licenses, count(*) AS files, CAST(sum(lines + holes) AS BIGINT) AS lines, CAST(sum(holes) AS BIGINT) AS holes,
          CAST(sum(holes * (len(string_split(host, '.')) - 1)) AS BIGINT) AS weighted FROM p GROUP BY host""",
    "bigrams_across_texts": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\w+') AS w FROM documents), i AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM w),
        g AS (SELECT t, lead(t) OVER (ORDER BY doc_id, i) AS u FROM i) SELECT t || ' ' || u AS gram, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY 1 ORDER BY n DESC, gram LIMIT 100""",
    "hits_by_bin_and_type": "SELECT (user_id + 1) // 10 * 10 AS bin, event_type, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM events GROUP BY 1, 2",
    "hint_mrr": r"""WITH w AS (SELECT role, regexp_extract_all(lower(text), '\w+') AS w FROM conversations), i AS (SELECT w, unnest(range(1, len(w))) AS i FROM w), n AS (SELECT w[i] AS ctx, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM i GROUP BY ALL),
        h AS (SELECT gram, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, gram) AS rank FROM n QUALIFY rank <= 20), f AS (SELECT role, w[1] || ' ' || w[2] AS gram FROM w WHERE len(w) > 1)
        SELECT role, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f LEFT JOIN h USING (gram) GROUP BY role""",
    "nearest_as_classifier": """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, vec_id DESC) AS far FROM d),
        b AS (SELECT query_id, (avg(dist) FILTER (WHERE near <= 30) + avg(dist) FILTER (WHERE far <= 100)) / 2 AS border FROM r GROUP BY query_id),
        t AS (SELECT query_id, near BETWEEN 31 AND 130 AS t, dist < border AS i FROM r JOIN b USING (query_id) WHERE near BETWEEN 31 AND 130 OR far BETWEEN 101 AND 200),
        o AS (SELECT query_id, count(*) FILTER (WHERE t AND i) AS tp, count(*) FILTER (WHERE i) AS retrieved FROM t GROUP BY query_id)
        SELECT *, round(CASE WHEN retrieved > 0 THEN tp / retrieved ELSE 0.0 END, 6) AS precision, round(tp / 100, 6) AS recall FROM o""",
    "position_errors": r"""WITH w AS (SELECT regexp_extract_all(text, '\w+') AS w FROM documents), i AS (SELECT len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS t FROM w)
        SELECT CAST(floor(i / n * 19) AS BIGINT) AS place, count(*) AS n, round(avg(length(t)), 6) AS mean, round(stddev_pop(length(t)) / sqrt(count(*)), 6) AS error FROM i GROUP BY 1""",
    "running_histogram": "WITH e AS (SELECT event_id, CAST(least(floor(value / 10), 9) AS BIGINT) AS tenth FROM events) SELECT event_id, tenth, count(*) OVER (PARTITION BY tenth ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM e",
    "bonus_draws": r"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\w+')) AS word FROM benchmark) GROUP BY word ORDER BY n DESC, word LIMIT 200),
        c AS (SELECT word, n * least(length(word), 5) AS weight, sum(n * least(length(word), 5)) OVER (ORDER BY word ROWS UNBOUNDED PRECEDING) AS hi, sum(n * least(length(word), 5)) OVER () AS total FROM w),
        d AS (SELECT draw, CAST('0x' || substr(md5('bonus-' || draw), 1, 12) AS BIGINT) AS u FROM range(200) r(draw))
        SELECT draw, word FROM d JOIN c ON u % total >= hi - weight AND u % total < hi""",
    "chunk_chain": f"""WITH c AS (SELECT regexp_extract_all({_VIS}, '...') AS w FROM benchmark), i AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM c), n AS (SELECT w[i] || w[i + 1] AS ctx, w[i + 2] AS next, count(*) AS n FROM i GROUP BY ALL)
        SELECT ctx, next, n, CAST(sum(n) OVER (PARTITION BY ctx ORDER BY next ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS lo, CAST(sum(n) OVER (PARTITION BY ctx) AS BIGINT) AS total FROM n ORDER BY n DESC, ctx, next LIMIT 100""",
    "rank_rollup": f"""WITH {_T} SELECT dist, count(*) AS n, round(avg(CASE WHEN rank0 >= 0 THEN 1.0::DOUBLE / (rank0 + 1) ELSE 0.0 END), 6) AS mrr,
        {", ".join(f"round(avg(CASE WHEN rank0 >= 0 AND rank0 < {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_{k}" for k in (1, 5, 10))} FROM t GROUP BY ROLLUP (dist)""",
    "balanced_trials": f"""WITH {_T}, h AS (SELECT *, row_number() OVER (PARTITION BY dist ORDER BY md5(sample || '-' || dist || '-' || l_partkey || '-' || l_suppkey || '-' || length), rank0) AS nth FROM t)
        SELECT dist, count(*) AS n, count(*) FILTER (WHERE rank0 >= 0) AS found FROM h WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM t GROUP BY dist)) GROUP BY dist""",
    "role_distances": """WITH c AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN '!' WHEN 'system' THEN '"' ELSE '#' END, '' ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
        SELECT a.conv_id, levenshtein(a.c, b.c) AS dist FROM c a JOIN c b ON b.conv_id - 1 = a.conv_id""",
    "candidate_kinds": r"""WITH b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '\w+') AS w FROM benchmark), f AS (SELECT t FROM (SELECT unnest(w) AS t FROM b) GROUP BY t ORDER BY count(*) DESC, t LIMIT 10),
        s AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(w) AS x FROM b), f WHERE x <> t GROUP BY id)
        SELECT id, 'DEL' AS kind, len(w) AS n FROM b WHERE len(w) > 0 UNION ALL SELECT id, 'INS', (len(w) + 1) * (SELECT count(*) FROM f) FROM b UNION ALL SELECT id, 'SUB', n FROM s""",
}
