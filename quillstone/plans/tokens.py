"""Lexing, chunking, encoding, offsets, chains and rerank queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexers as L, rewrites as R, text as X
from ..operators import markov, vecindex
from ..sources.corpus import lines, table, with_tokens
from .search import _KNN


def lexeme_kinds(spark, sf):
    """Lexemes and characters by kind, all pages."""
    t = table(spark, sf, "pages").select(F.explode(L.lexemes(F.col("html"))).alias("t"))
    return t.groupBy(L.lexeme_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars"))


def coarse_patterns(spark, sf):
    """The 100 most frequent coarsened lines of all pages."""
    t = lines(table(spark, sf, "pages"), "html").select(F.array_join(L.coarsened(L.lexemes(F.col("line"))), " ").alias("pattern"))
    return t.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(100)


def token_chunks(spark, sf):
    """Overlapping windows of 760 words, 380 apart, of every document."""
    d = with_tokens(table(spark, sf, "documents"), X.words(F.col("text")), "doc_id")
    c = d.select("doc_id", F.posexplode(X.overlapping_chunks(F.col("w"))).alias("chunk", "c"))
    return c.select("doc_id", F.col("chunk").cast("long"), F.md5(F.array_join("c", " ")).alias("chunk_md5"))


def growing_prefixes(spark, sf):
    """Each turn with the digest of its conversation up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(w), "\n")).alias("prefix_md5"))


def position_histogram(spark, sf):
    """Word lengths by twentieth of the document: mean and deviation."""
    d = with_tokens(table(spark, sf, "documents"), X.words(F.col("text")))
    t = d.select(F.size("w").alias("size"), F.posexplode("w").alias("pos", "t"))
    return t.groupBy(F.floor(F.col("pos") * 20 / F.col("size")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("t")), 6).alias("mean"), F.round(F.stddev_pop(F.length("t")), 6).alias("dev"))


def keyboard_travel(spark, sf):
    """Finger travel over the letters of each item's words."""
    t = table(spark, sf, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("t"))
    pairs = t.where(F.length("t") > 1).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substr("t", i, F.lit(2)))).alias("p"))
    return pairs.groupBy("item_id").agg(F.round(F.sum(X.keyboard_distance(F.substring("p", 1, 1), F.substring("p", 2, 1))), 4).alias("travel"))


def grep_offsets(spark, sf):
    """Every run of digits in every document, with its 0-based offset."""
    gaps, hits = F.split("text", "[0-9]+", -1), F.regexp_extract_all("text", F.lit("[0-9]+"), 0)
    d = table(spark, sf, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.posexplode(F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))).alias("i", "z"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("z.gap") + F.coalesce(F.length("z.hit"), F.lit(0))).over(w), F.lit(0))
    return d.select("doc_id", (before + F.col("z.gap")).cast("long").alias("at"), F.col("z.hit").alias("hit")).where("hit is not null")


def complexity_bins(spark, sf):
    return table(spark, sf, "pages").groupBy(F.bround(X.approx_cyclomatic(F.col("html")) / 5).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pretty_columns(spark, sf):
    """Suppliers as lines of columns padded to the widest value."""
    s = table(spark, sf, "supplier").select("s_suppkey", *[F.col(c).cast("string").alias(c) for c in ("s_name", "s_nationkey")])
    width = s.agg(F.max(F.length("s_name")).alias("a"), F.max(F.length("s_nationkey")).alias("b"))
    return s.crossJoin(F.broadcast(width)).select("s_suppkey", F.concat_ws(", ", F.rpad("s_name", F.col("a"), F.lit(" ")), F.rpad("s_nationkey", F.col("b"), F.lit(" "))).alias("line"))  # one row


def vocabulary_ids(spark, sf):
    """Words of each document and those outside the 500 most frequent."""
    d = table(spark, sf, "documents").select("doc_id", X.words(F.lower("text")).alias("w"))
    counts = d.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("total"))
    known = [r["token"] for r in counts.orderBy(F.desc("total"), "token").limit(500).collect()]  # 500 rows
    own = with_tokens(d, F.col("w"), "doc_id").where(F.size("w") > 0)
    rows = own.select("doc_id", F.size("w").alias("n"), F.size(F.filter("w", lambda t: ~t.isin(known))).alias("unknown"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("unknown").alias("unknown"))  # a document is a row, but for repeated ids


def knn_rerank(spark, sf):
    """The 20 nearest of every hundredth vector by L2, reranked by L1: the ten best with their former rank."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = vecindex.knn(e, e.where("vec_id % 100 = 0"), 20).select("query_id", "vec_id", F.col("rank").alias("before"))
    both = near.join(e.withColumnRenamed("embedding", "a"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("b")), "query_id")
    l1 = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", "vec_id", "before", F.round(l1, 6).alias("l1"))
    w = Window.partitionBy("query_id").orderBy("l1", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "vec_id", F.col("before").cast("long"), F.col("rank").cast("long"), "l1")


def markov_walks(spark, sf):
    """Two hundred walks of ten draws over the bigrams of all turns, from the item words in alphabetical order."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text")))
    grams = t.select(F.explode(X.ngrams(F.col("w"), 2)).alias("g")).select(F.substring_index("g", " ", 1).alias("ctx"), F.substring_index("g", " ", -1).alias("next"))
    chain = markov.transitions(grams)
    starts = chain.select("ctx").distinct().orderBy("ctx").limit(200).select(F.row_number().over(Window.orderBy("ctx")).cast("long").alias("walk"), "ctx")
    return markov.walks(chain, starts, 10).select("walk", F.array_join("words", " ").alias("words"))


def pair_swap(spark, sf):
    """Adjacent turns as sentence pairs; half of the pairs, by hash, are swapped and labelled so."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    p = c.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    p = p.withColumn("swapped", (R.seed("conv_id", "turn") % 2).cast("long"))
    return p.select("conv_id", "turn", "swapped", F.md5(F.when(F.col("swapped") == 1, F.concat("b", F.lit("\n"), "a")).otherwise(F.concat("a", F.lit("\n"), "b"))).alias("pair_md5"))


_KIND = f"""CASE WHEN substr(t, 1, 2) IN ('//', '/*') THEN 'comment' WHEN substr(t, 1, 1) IN ('"', '''') AND length(t) > 1 THEN 'string' WHEN regexp_matches(t, '^[0-9]') THEN 'number'
  WHEN t IN ({", ".join(f"'{w}'" for w in X.RESERVED)}) THEN 'keyword' WHEN regexp_matches(t, '^[A-Za-z_$]') THEN 'name' WHEN regexp_matches(t, '^[ \\t\\r\\n]') THEN 'space' ELSE 'operator' END"""
_LEX = L.LEXEME.replace("'", "''")
_KEY = f"(instr('.LO,KIMJUNHYBGTVFRCDEXSWZAQ', substr(p, %d, 1)) - 1)"
_DX, _DY = (f"({e % (_KEY % 1)} - {e % (_KEY % 2)})" for e in ("(%s %% 3) * 4.0::DOUBLE", "%s * (2.0::DOUBLE / 3.0::DOUBLE)"))

QUERIES = {f.__name__: f for f in (
    lexeme_kinds, coarse_patterns, token_chunks, growing_prefixes, position_histogram, keyboard_travel, grep_offsets, complexity_bins, pretty_columns, vocabulary_ids, knn_rerank, markov_walks, pair_swap)}
ORACLE_SQL = {
    "lexeme_kinds": f"SELECT {_KIND} AS kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT unnest(regexp_extract_all(html, '{_LEX}')) AS t FROM pages) GROUP BY 1",
    "coarse_patterns": rf"""WITH l AS (SELECT unnest(string_split_regex(html, '\r\n|\n|\r')) AS l FROM pages),
        c AS (SELECT array_to_string(list_transform(list_filter(regexp_extract_all(l, '{_LEX}'), lambda t: {_KIND} <> 'space'),
          lambda t: CASE {_KIND} WHEN 'name' THEN 'w' WHEN 'number' THEN '0' WHEN 'string' THEN '""' WHEN 'comment' THEN '//' ELSE t END), ' ') AS pattern FROM l)
        SELECT pattern, count(*) AS n FROM c GROUP BY pattern ORDER BY n DESC, pattern LIMIT 100""",
    "token_chunks": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\w+') AS w FROM documents),
        c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) >= 760 THEN (len(w) - 760) // 380 + 1 ELSE 0 END)) AS chunk FROM w)
        SELECT doc_id, chunk, md5(array_to_string(w[chunk * 380 + 1:chunk * 380 + 760], ' ')) AS chunk_md5 FROM c""",
    "growing_prefixes": "SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS prefix_md5 FROM conversations",
    "position_histogram": r"""WITH w AS (SELECT regexp_extract_all(text, '\w+') AS w FROM documents), t AS (SELECT len(w) AS size, unnest(range(len(w))) AS pos, unnest(w) AS t FROM w)
        SELECT pos * 20 // size AS bucket, count(*) AS n, round(avg(length(t)), 6) AS mean, round(stddev_pop(length(t)), 6) AS dev FROM t GROUP BY 1""",
    "keyboard_travel": f"""WITH t AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM benchmark), p AS (SELECT item_id, substr(t, i, 2) AS p FROM (SELECT *, unnest(range(1, length(t))) AS i FROM t))
        SELECT item_id, round(sum(sqrt({_DX} * {_DX} + {_DY} * {_DY}) * 4.76::DOUBLE), 4) AS travel FROM p GROUP BY item_id""",
    "grep_offsets": r"""WITH s AS (SELECT doc_id, string_split_regex(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS h FROM documents WHERE regexp_matches(text, '[0-9]')),
        z AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS gap FROM s)
        SELECT doc_id, CAST(coalesce(sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS BIGINT) AS at, hit FROM z""",
    "complexity_bins": "SELECT CAST(round_even(len(list_filter(regexp_extract_all(html, '(?s)\\w+|\\W'), lambda t: t IN (" + ", ".join(f"'{w}'" for w in X.CONTROL + X.BRACKETS) + "))) / 5, 0) AS BIGINT) AS bin, count(*) AS n FROM pages GROUP BY 1",
    "pretty_columns": "SELECT s_suppkey, rpad(s_name, CAST(max(length(s_name)) OVER () AS INTEGER), ' ') || ', ' || rpad(CAST(s_nationkey AS VARCHAR), CAST(max(length(CAST(s_nationkey AS VARCHAR))) OVER () AS INTEGER), ' ') AS line FROM supplier",
    "vocabulary_ids": r"""WITH t AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS token FROM documents) GROUP BY ALL),
        v AS (SELECT token, sum(n) AS total FROM t GROUP BY token ORDER BY total DESC, token LIMIT 500)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN token IN (SELECT token FROM v) THEN 0 ELSE n END) AS BIGINT) AS unknown FROM t GROUP BY doc_id""",
    "knn_rerank": f"""WITH {_KNN % 20}, s AS (SELECT k.query_id, k.vec_id, k.rank AS before, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6) AS l1
          FROM k JOIN embeddings a ON a.vec_id = k.vec_id JOIN embeddings b ON b.vec_id = k.query_id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l1, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "markov_walks": r"""WITH RECURSIVE g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {'ctx': w[i], 'next': w[i + 1]})) AS g FROM (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM conversations)),
        n AS (SELECT g.ctx AS ctx, g.next AS next, count(*) AS n FROM g GROUP BY 1, 2),
        x AS (SELECT *, sum(n) OVER (PARTITION BY ctx ORDER BY next) AS hi, sum(n) OVER (PARTITION BY ctx) AS total FROM n),
        s AS (SELECT row_number() OVER (ORDER BY ctx) AS walk, ctx FROM (SELECT DISTINCT ctx FROM x) ORDER BY ctx LIMIT 200),
        r AS (SELECT walk, 0 AS i, ctx AS at, ctx AS words FROM s UNION ALL
          SELECT walk, i + 1, next, CASE WHEN next IS NULL THEN words ELSE words || ' ' || next END
          FROM (SELECT *, CAST('0x' || substr(md5(walk || '-' || i), 1, 12) AS BIGINT) AS u FROM r WHERE i < 10) r LEFT JOIN x ON x.ctx = r.at AND u % total >= hi - n AND u % total < hi)
        SELECT walk, words FROM r WHERE i = 10""",
    "pair_swap": """WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, CAST('0x' || substr(md5(conv_id || '-' || turn), 1, 7) AS BIGINT) % 2 AS swapped FROM conversations)
        SELECT conv_id, turn, swapped, md5(CASE WHEN swapped = 1 THEN b || chr(10) || a ELSE a || chr(10) || b END) AS pair_md5 FROM p WHERE b IS NOT NULL""",
}
