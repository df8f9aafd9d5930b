"""Corpus statistics, token models, text metrics and rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stats
from ..sources.corpus import table, with_tokens


def _docs(spark, sf):
    return table(spark, sf, "documents")


def line_stats_by_source(spark, sf):
    ls = F.split("text", "\n", -1)
    holes = F.filter(ls, lambda x: ~X.is_comment_or_empty(x))
    d = _docs(spark, sf).select("source", "lang", F.size(ls).alias("l"), F.size(holes).alias("h"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("l").alias("lines"), F.sum("h").alias("holes"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def license_classes(spark, sf):
    return _docs(spark, sf).groupBy(X.license_class(F.col("text"), X.CORPUS_LICENSES).alias("license")).agg(F.count(F.lit(1)).alias("n"))


def license_cascade(spark, sf):
    """Pages by the first licence mark in their source."""
    return table(spark, sf, "pages").groupBy(X.license_class(F.col("html")).alias("license")).agg(F.count(F.lit(1)).alias("n"))


def token_freq(spark, sf):
    tokens = _docs(spark, sf).select(F.explode(X.words(F.col("text"))).alias("token"))
    return stats.relative_frequency(tokens, "token").orderBy(F.desc("n"), "token").limit(200)


def bigram_freq(spark, sf):
    grams = with_tokens(_docs(spark, sf), X.words(F.col("text"))).select(X.bigrams(F.col("w")))
    n = grams.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))  # strings are built for distinct pairs only
    total = n.agg(F.sum("n").alias("total"))
    freq = n.crossJoin(F.broadcast(total)).select(F.concat_ws(" ", "a", "b").alias("gram"), "n", F.round(F.col("n") / F.col("total"), 6).alias("freq"))  # one row
    return freq.orderBy(F.desc("n"), "gram").limit(100)


def length_cdf(spark, sf):
    return stats.cumulative(_docs(spark, sf), X.bucket10(F.size(X.words(F.col("text"))).cast("long")))


def length_buckets(spark, sf):
    n = F.size(X.words(F.col("text"))).cast("long")
    return stats.cumulative(_docs(spark, sf), F.when(n >= 100, 100).otherwise(X.bucket10(n)).cast("long"))


def bin10_counts(spark, sf):
    n = F.size(X.words(F.col("text"))).cast("long")
    return _docs(spark, sf).groupBy(X.bin10(n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rouge_recall(spark, sf):
    """The three documents of highest recall of each item's words, at four fifths of them or more.

    A document with four fifths of an item's n words holds one of the item's n - ceil(4 n / 5) + 1 rarest (prefix filter), so only
    those make candidates, and only candidates are compared in full."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(X.words(F.lower("text"))).alias("w")).where(F.size("w") > 0)
    d = _docs(spark, sf).select("doc_id", F.array_distinct(X.words(F.lower("text"))).alias("dw"))
    item = b.select("item_id", F.size("w").alias("size"), F.explode("w").alias("token"))
    each = d.select("doc_id", F.explode("dw").alias("token")).join(item.select("token").distinct(), "token", "left_semi")
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "token"))
    rare = item.join(seen, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * 4 / 5) + 1)
    able = each.join(rare.select("token", "item_id"), "token").select("doc_id", "item_id").distinct()
    full = able.join(d, "doc_id").join(b, "item_id").select("item_id", "doc_id", F.round(F.size(F.array_intersect("w", "dw")) / F.size("w"), 6).alias("recall"))
    return stats.take_per_group(full.where("recall >= 0.8"), ["item_id"], 3, F.desc("recall"), F.asc("doc_id"))


def bracket_balance(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.bracket_balance(F.col("html")).alias("balance"), X.count_of(F.col("html"), "<").alias("tags"))


def approx_cyclomatic(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.approx_cyclomatic(F.col("html")).alias("complexity"))


def comment_lines(spark, sf):
    ls = F.split("text", "\n", -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.filter(ls, lambda x: X.is_comment_or_empty(x))).cast("long").alias("n"))


def visible_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(X.visible_chars(F.col("text"))).alias("visible_md5"))


def normal_form_distance(spark, sf):
    """Distance of each item to the item before it, tokens renamed to first-occurrence numbers."""
    c = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    pairs = c.join(c.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id")
    return pairs.select("item_id", X.normal_form_distance(F.col("t"), F.col("u")).cast("long").alias("dist"))


def sct_swap_plus_minus(spark, sf):
    d = _docs(spark, sf)
    new = X.swap_plus_minus(F.col("text"))
    return d.where(new != F.col("text")).select("doc_id", F.md5(new).alias("variant_md5"))


def sct_rename(spark, sf):
    """The most frequent identifier (over four characters, lower-case first; ties: first seen) gets another name."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    tok = c.select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("pos", "token")).where(F.col("token").rlike("^[a-z]") & (F.length("token") > 4) & ~F.col("token").isin(*X.RESERVED))
    count = tok.groupBy("conv_id", "turn", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    mode = stats.take_per_group(count, ["conv_id", "turn"], 1, F.desc("n"), F.asc("first"))
    return c.join(mode, ["conv_id", "turn"]).select("conv_id", "turn", "token", "n", F.md5(F.replace("text", F.col("token"), F.lit("renamed"))).alias("variant_md5"))


def sct_factorial_pivot(spark, sf):
    """Rewrites by source: how often the text changes."""
    d = _docs(spark, sf).select("source", "text")
    txs = {"swap": X.swap_plus_minus(F.col("text")), "visible": X.visible_chars(F.col("text")), "lower": F.lower("text")}
    each = d.select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("sct"), (v != F.col("text")).cast("double").alias("changed")) for k, v in txs.items()])).alias("x")).select("source", "x.*")
    return each.groupBy("source").pivot("sct", sorted(txs)).agg(F.round(F.avg("changed"), 6))


def ttest_paired(spark, sf):
    d = _docs(spark, sf).select("lang", F.size(X.words(F.col("text"))).alias("a"), F.size(F.split("text", " ", -1)).alias("b"))
    return stats.paired_t(d, "a", "b", "lang")


def stratified_split(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    val = stats.take_per_group(l, ["quality", "toxic"], 20, F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    return val.select("doc_id", "quality", "toxic")


def rebalance_min_class(spark, sf):
    return stats.rebalanced(table(spark, sf, "labels"), "toxic", F.md5(F.col("doc_id").cast("string")), F.col("doc_id")).select("doc_id", "toxic")


def ngram_counts_merge(spark, sf):
    grams = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text"))).select(F.explode(X.ngrams(F.col("w"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(100)


def ngram_score(spark, sf):
    """Mean negative log-probability of each turn under the bigrams of its role, add-one on the pair."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text")), "conv_id", "turn", "role")
    pairs = t.select("conv_id", "turn", "role", F.explode(X.ngrams(F.col("w"), 2)).alias("gram")).withColumn("ctx", F.substring_index("gram", " ", 1))
    both = pairs.groupBy("role", "gram", "ctx").agg(F.count(F.lit(1)).alias("c"))
    ctx = both.groupBy("role", "ctx").agg(F.sum("c").alias("total"))
    scored = pairs.join(both.join(ctx, ["role", "ctx"]), ["role", "gram", "ctx"])
    return scored.groupBy("conv_id", "turn").agg(F.round(F.avg(-F.log((F.col("c") + 1.0) / (F.col("total") + 1.0))), 6).alias("nll"))


def cooccurrence_probability(spark, sf):
    grams = with_tokens(table(spark, sf, "benchmark"), X.words(F.lower("text"))).select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram"))
    n = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("left", F.substring_index("gram", " ", 1))
    return n.select("gram", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("left")), 6).alias("p"))


def mask_identifiers(spark, sf):
    """A masked variant for each identifier that occurs at least twice."""
    c = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array_distinct(X.identifiers(F.col("text")))).alias("id"))
    return c.withColumn("n", F.size(F.split("text", F.concat(F.lit("\\Q"), F.col("id"), F.lit("\\E")), -1)) - 1).where("n >= 2").select(
        "item_id", "id", F.col("n").cast("long"), F.md5(F.replace("text", F.col("id"), F.lit("<mask>"))).alias("masked_md5"))


def distractors(spark, sf):
    """For each turn's first word the five rarest identifiers of the conversation that start otherwise."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ids = c.select("conv_id", F.explode(X.identifiers(F.col("text"))).alias("id")).groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"))
    first = c.select("conv_id", "turn", F.get(X.words(F.col("text")), F.lit(0)).alias("truth")).where("truth is not null")
    # the five wanted are among the five rarest of each first letter, so a long conversation's words are not met by all its turns
    letters = stats.take_per_group(ids.withColumn("letter", F.substring("id", 1, 1)), ["conv_id", "letter"], 5, F.asc("n"), F.asc("id"))
    far = first.join(letters, "conv_id").where(F.col("letter") != F.substring("truth", 1, 1))
    return stats.take_per_group(far, ["conv_id", "turn"], 5, F.asc("n"), F.asc("id")).select("conv_id", "turn", "truth", "id", "n")


def href_extract(spark, sf):
    hrefs = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return hrefs.groupBy("href").agg(F.countDistinct("page_id").alias("pages"))


def url_mining(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), X.extension(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)).alias("tld"))
    return p.groupBy("tld").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


def dedupe_repos(spark, sf):
    """URLs without scheme, host prefix, query and fragment: first page of each and how many there are."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://(www\\.|m\\.|blog\\.)?", ""), "[?#].*$", "").alias("key"))
    return p.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


def vocabulary(spark, sf):
    """Reserved tokens and the most frequent words, numbered."""
    words = _docs(spark, sf).select(F.explode(X.words(F.lower("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = words.orderBy(F.desc("n"), "token").limit(500).withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 4)
    reserved = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("[MASK]", 4)], "token string, id int")
    return reserved.unionByName(top.select("token", "id")).select("token", F.col("id").cast("long"))


def sentence_pairs(spark, sf):
    """Non-overlapping pairs of consecutive turns; an odd last turn is dropped."""
    c = table(spark, sf, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    g = c.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 2").select("conv_id", "pair", F.md5(F.concat("a", F.lit(" "), "b")).alias("pair_md5"))


def vec_mean_by_label(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"))


def vec_l1_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("v"))
    return e.select("vec_id", F.round(F.array_max(X.l1_normalised(F.col("v"))), 6).alias("top"))


def dim_corr(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("dim").agg(F.round(F.corr("x", "label"), 6).alias("r"))


def ranking_by_label(spark, sf):
    """Rank of the first document of the same language after each one, within its source: MRR and P@k by language."""
    d = _docs(spark, sf).select("doc_id", "source", "lang")
    w = Window.partitionBy("source").orderBy("doc_id")
    same = Window.partitionBy("source", "lang").orderBy("doc_id")
    d = d.withColumn("i", F.row_number().over(w)).withColumn("j", F.lead("i").over(same))
    return stats.ranking_metrics(d.withColumn("rank0", F.coalesce(F.col("j") - F.col("i") - 1, F.lit(-1))), "rank0", (1, 5, 10), "lang")


_W = r"regexp_extract_all(%s, '\w+')"
_LIC = "CASE WHEN contains(text, 'Apache License') THEN 'Apache' WHEN contains(text, 'GNU General Public License') THEN 'GPL' WHEN contains(text, 'MIT License') THEN 'MIT' WHEN contains(text, 'icensed under') OR contains(text, 'rights reserved') THEN 'Custom' ELSE '?' END"
_EMPTY = "(length(trim(x)) <= 1 OR substr(trim(x), 1, 2) IN ('//', '* ', '/*'))"
_RES = ", ".join(f"'{w}'" for w in X.RESERVED)
_IDS = rf"list_filter(regexp_extract_all(text, '\w+'), lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]') AND t NOT IN ({_RES}))"
_GRAM2 = r"SELECT %s, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT *, regexp_extract_all(%s, '\w+') AS w FROM %s)"
_BAL = " + ".join(f"(length(html) - length(replace(html, '{o}', ''))) - (length(html) - length(replace(html, '{c}', '')))" for o, c in ("()", "[]", "{}"))

QUERIES = {f.__name__: f for f in (
    line_stats_by_source, license_classes, license_cascade, token_freq, bigram_freq, length_cdf, length_buckets, bin10_counts, rouge_recall, bracket_balance, approx_cyclomatic, comment_lines,
    visible_text, normal_form_distance, sct_swap_plus_minus, sct_rename, sct_factorial_pivot, ttest_paired, stratified_split, rebalance_min_class, ngram_counts_merge, ngram_score,
    cooccurrence_probability, mask_identifiers, distractors, href_extract, url_mining, dedupe_repos, vocabulary, sentence_pairs, vec_mean_by_label, vec_l1_normalize, dim_corr, ranking_by_label)}
ORACLE_SQL = {
    "line_stats_by_source": f"SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: NOT {_EMPTY}))) AS BIGINT) AS holes, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source",
    "license_classes": f"SELECT {_LIC} AS license, count(*) AS n FROM documents GROUP BY 1",
    "license_cascade": "SELECT CASE WHEN contains(html, 'Apache ') THEN 'Apache' WHEN contains(html, 'GPL ') THEN 'GPL' WHEN contains(html, 'MIT license') THEN 'MIT' WHEN contains(html, 'Copyright (') THEN 'Custom' ELSE '?' END AS license, count(*) AS n FROM pages GROUP BY 1",
    "token_freq": f"WITH t AS (SELECT unnest({_W % 'text'}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT token, n, round(n / sum(n) OVER (), 4) AS freq FROM c ORDER BY n DESC, token LIMIT 200",
    "bigram_freq": f"WITH t AS ({_GRAM2 % ('doc_id', 'text', 'documents')}), c AS (SELECT gram, count(*) AS n FROM t GROUP BY gram) SELECT gram, n, round(n / sum(n) OVER (), 6) AS freq FROM c ORDER BY n DESC, gram LIMIT 100",
    "length_cdf": f"WITH c AS (SELECT len({_W % 'text'}) // 10 * 10 AS bucket, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, n, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS cdf FROM c",
    "length_buckets": f"WITH c AS (SELECT least(len({_W % 'text'}) // 10 * 10, 100) AS bucket, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, n, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS cdf FROM c",
    "bin10_counts": f"SELECT (len({_W % 'text'}) + 1) // 10 * 10 AS bin, count(*) AS n FROM documents GROUP BY 1",
    "rouge_recall": f"WITH b AS (SELECT item_id, list_distinct({_W % 'lower(text)'}) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({_W % 'lower(text)'})) AS token FROM documents), u AS (SELECT item_id, unnest(w) AS token FROM b), s AS (SELECT doc_id, item_id, count(*) AS n FROM d JOIN u USING (token) GROUP BY ALL), f AS (SELECT item_id, doc_id, round(n / len(w)::DOUBLE, 6) AS recall FROM s JOIN b USING (item_id)) SELECT * FROM f WHERE recall >= 0.8 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY recall DESC, doc_id) <= 3",
    "bracket_balance": f"SELECT page_id, CAST({_BAL} AS BIGINT) AS balance, CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS tags FROM pages",
    "approx_cyclomatic": "SELECT page_id, len(list_filter(regexp_extract_all(html, '(?s)\\w+|\\W'), lambda t: t IN (" + ", ".join(f"'{w}'" for w in X.CONTROL + X.BRACKETS) + "))) AS complexity FROM pages",
    "comment_lines": f"SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: {_EMPTY})) AS n FROM conversations",
    "visible_text": "SELECT item_id, md5(regexp_replace(text, '[^!-~]', '', 'g')) AS visible_md5 FROM benchmark",
    "normal_form_distance": r"""WITH c AS (SELECT item_id, regexp_extract_all(text, '(?s)[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[ \t\n\r]+|.') AS t FROM benchmark),
        p AS (SELECT a.item_id, a.t AS x, b.t AS y, a.t || b.t AS z FROM c a JOIN c b ON b.item_id - 1 = a.item_id),
        n AS (SELECT *, list_filter(z, lambda t, i: list_position(z, t) = i) AS names FROM p)
        SELECT item_id, levenshtein(array_to_string(list_transform(x, lambda t: list_position(names, t) - 1), ''), array_to_string(list_transform(y, lambda t: list_position(names, t) - 1), '')) AS dist FROM n""",
    "sct_swap_plus_minus": "SELECT doc_id, md5(replace(text, '+', '-')) AS variant_md5 FROM documents WHERE contains(text, '+')",
    "sct_rename": rf"WITH t AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT *, regexp_extract_all(text, '\w+') AS w FROM conversations)), c AS (SELECT conv_id, turn, token, count(*) AS n, min(pos) AS first FROM t WHERE regexp_matches(token, '^[a-z]') AND length(token) > 4 AND token NOT IN ({_RES}) GROUP BY ALL), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) = 1) SELECT conv_id, turn, token, n, md5(replace(text, token, 'renamed')) AS variant_md5 FROM conversations JOIN m USING (conv_id, turn)",
    "sct_factorial_pivot": "SELECT source, round(avg(CAST(lower(text) <> text AS DOUBLE)), 6) AS lower, round(avg(CAST(contains(text, '+') AS DOUBLE)), 6) AS swap, round(avg(CAST(regexp_replace(text, '[^!-~]', '', 'g') <> text AS DOUBLE)), 6) AS visible FROM documents GROUP BY source",
    "ttest_paired": f"WITH d AS (SELECT lang, CAST(len({_W % 'text'}) - len(string_split(text, ' ')) AS DOUBLE) AS d FROM documents) SELECT lang, count(d) AS n, CASE WHEN count(d) > 2 AND stddev_samp(d) > 0 THEN round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) END AS t FROM d GROUP BY lang",
    "stratified_split": "SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 20",
    "rebalance_min_class": "SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM labels) WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))",
    "ngram_counts_merge": r"WITH t AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM conversations)) SELECT gram, count(*) AS n FROM t GROUP BY gram ORDER BY n DESC, gram LIMIT 100",
    "ngram_score": f"WITH p AS (SELECT *, split_part(gram, ' ', 1) AS ctx FROM ({_GRAM2 % ('conv_id, turn, role', 'lower(text)', 'conversations')})), b AS (SELECT role, gram, ctx, count(*) AS c FROM p GROUP BY ALL), x AS (SELECT role, ctx, sum(c) AS total FROM b GROUP BY ALL) SELECT conv_id, turn, round(avg(-ln((c + 1.0::DOUBLE) / (total + 1.0::DOUBLE))), 6) AS nll FROM p JOIN b USING (role, gram, ctx) JOIN x USING (role, ctx) GROUP BY conv_id, turn",
    "cooccurrence_probability": f"WITH g AS ({_GRAM2 % ('item_id', 'lower(text)', 'benchmark')}), n AS (SELECT gram, count(*) AS n, split_part(gram, ' ', 1) AS l FROM g GROUP BY gram) SELECT gram, round(n / sum(n) OVER (PARTITION BY l), 6) AS p FROM n",
    "mask_identifiers": f"WITH c AS (SELECT item_id, text, unnest(list_distinct({_IDS})) AS id FROM benchmark), n AS (SELECT *, (length(text) - length(replace(text, id, ''))) // length(id) AS n FROM c) SELECT item_id, id, CAST(n AS BIGINT) AS n, md5(replace(text, id, '<mask>')) AS masked_md5 FROM n WHERE n >= 2",
    "distractors": f"WITH i AS (SELECT conv_id, id, count(*) AS n FROM (SELECT conv_id, unnest({_IDS}) AS id FROM conversations) GROUP BY ALL), f AS (SELECT conv_id, turn, ({_W % 'text'})[1] AS truth FROM conversations) SELECT conv_id, turn, truth, id, n FROM f JOIN i USING (conv_id) WHERE truth IS NOT NULL AND substr(id, 1, 1) <> substr(truth, 1, 1) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n, id) <= 5",
    "href_extract": "SELECT href, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href",
    "url_mining": "SELECT split_part(host, '.', -1) AS tld, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages) GROUP BY 1",
    "dedupe_repos": "SELECT regexp_replace(regexp_replace(url, '^https?://(www\\.|m\\.|blog\\.)?', ''), '[?#].*$', '') AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "vocabulary": f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_W % 'lower(text)'}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 500) SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS id FROM c UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4))",
    "sentence_pairs": "SELECT conv_id, turn // 2 AS pair, md5(max(text) FILTER (WHERE turn % 2 = 0) || ' ' || max(text) FILTER (WHERE turn % 2 = 1)) AS pair_md5 FROM conversations GROUP BY 1, 2 HAVING count(*) = 2",
    "vec_mean_by_label": "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY label, dim",
    "vec_l1_normalize": "SELECT vec_id, round(list_max(v) / list_sum(v), 6) AS top FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS v FROM embeddings)",
    "dim_corr": "SELECT CAST(dim AS INTEGER) AS dim, round(corr(CAST(x AS DOUBLE), CAST(label AS DOUBLE)), 6) AS r FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY dim",
    "ranking_by_label": "WITH i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), j AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY source, lang ORDER BY doc_id) - i - 1, -1) AS r FROM i) SELECT lang, count(*) AS n, round(avg(CASE WHEN r >= 0 THEN 1.0::DOUBLE / (r + 1) ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN r >= 0 AND r < 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_1, round(avg(CASE WHEN r >= 0 AND r < 5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_5, round(avg(CASE WHEN r >= 0 AND r < 10 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_10 FROM j GROUP BY lang",
}
