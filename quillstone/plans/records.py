"""Records, listings, encodings and type hierarchies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coding, lexers, text as X
from ..operators import relalg, stats
from ..sources import records
from ..sources.corpus import lines, table, with_tokens

#: Kinds of lexemes in their order.
KINDS = ["comment", "keyword", "name", "number", "operator", "space", "string"]


def hash_lookup(spark, sf):
    """Hashes of all page addresses and of all items' texts, looked up among the addresses."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("uri"))
    wanted = pages.select(F.md5("uri").alias("hash")).unionByName(table(spark, sf, "benchmark").select(F.md5("text").alias("hash")))
    return records.by_hash(wanted, records.hash_index(pages)).groupBy("uri").agg(F.count(F.lit(1)).alias("n"))


def balanced_records(spark, sf):
    """Consecutive turns as 4-line records with base64 sources, read back; system turns are the training side."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    pairs = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") / 2).cast("long").alias("p"), F.col("text").alias("a")).join(
        c.where("turn % 2 = 1").select("conv_id", ((F.col("turn") - 1) / 2).cast("long").alias("p"), F.col("text").alias("b")), ["conv_id", "p"])
    flat = lambda t: F.array_join(X.words(t), " ")
    code = lambda t: F.base64(F.encode(t, "UTF-8"))
    rows = pairs.select((F.col("conv_id") * 1000 + F.col("p")).alias("record"), F.posexplode(F.array(flat(F.col("a")), flat(F.col("b")), code(F.col("a")), code(F.col("b")))).alias("i", "value"))
    known = c.where("role = 'system'").select(flat(F.col("text")).alias("broken"))
    out = records.balanced_records(rows.select((F.col("record") * 4 + F.col("i")).alias("ordinal"), "value"), known, 3)
    return out.select("bucket", "dist", F.md5("broken_src").alias("broken_md5"), F.md5("fixed_src").alias("fixed_md5"))


def _hosts(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))


def hosts_without_copies(spark, sf):
    """Hosts without a prefix that no prefixed host repeats."""
    h = _hosts(spark, sf)
    prefix = r"^(www|m|blog)\."
    copies = h.where(F.col("host").rlike(prefix)).select(F.regexp_replace("host", prefix, "").alias("host"))
    return records.without_copies(h.where(~F.col("host").rlike(prefix)), copies, "host").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def page_badges(spark, sf):
    admitted = records.page_admits(F.col("html"), "</article>", ["###", "$$$"], 3500)
    return table(spark, sf, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).agg(F.sum(admitted.cast("long")).alias("admitted"), F.count(F.lit(1)).alias("n"))


def repository_listing(spark, sf):
    """Parts as a listing of repositories."""
    p = table(spark, sf, "part").select(
        F.concat_ws("-", "p_partkey", "p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "User").otherwise("Organization").alias("owner_type"), (F.col("p_size") * 10).alias("forks"),
        (F.col("p_partkey") * 31 % 12000).alias("size"), (F.col("p_partkey") * 7919 % 100003).alias("stars"), (F.col("p_partkey") * 13 % 97).alias("issues"), F.col("p_name").alias("text"))
    return records.sample_repositories(p, most=200).select("name", "stars", "issues")


def method_stats(spark, sf):
    ls = F.split("text", "\n", -1)
    comment = lambda x: X.is_comment_or_empty(x)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    d = with_tokens(table(spark, sf, "documents"), X.words(F.col("text")), "doc_id", "text")
    return d.select("doc_id", F.size(ls).cast("long").alias("lines"), F.size("w").cast("long").alias("tokens"), F.round(F.size("w") / F.size(ls), 6).alias("mean"),
                    total(F.filter(ls, comment)).alias("comment_chars"), total(F.filter(ls, lambda x: ~comment(x))).alias("code_chars"))


def type_inheritance(spark, sf):
    """Hosts as types under the host without its first label: own pages, supertypes, and pages of all supertypes."""
    own = _hosts(spark, sf).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("own"))
    up = lambda c: F.substr(c, F.instr(c, ".") + 1)
    level = own.select("host").distinct()
    edges = level.where(F.contains("host", F.lit("."))).select(F.col("host").alias("src"), up(F.col("host")).alias("dst"))
    for _ in range(4):
        level = edges.select(F.col("dst").alias("host")).distinct()
        edges = edges.unionByName(level.where(F.contains("host", F.lit("."))).select(F.col("host").alias("src"), up(F.col("host")).alias("dst"))).distinct()
    above = relalg.closure(edges, 6)
    inherited = above.join(own.select(F.col("host").alias("dst"), "own"), "dst", "left").groupBy(F.col("src").alias("host")).agg(
        F.count(F.lit(1)).alias("supertypes"), F.coalesce(F.sum("own"), F.lit(0)).alias("inherited"))
    return own.join(inherited, "host", "left").select("host", "own", F.coalesce("supertypes", F.lit(0)).alias("supertypes"), F.coalesce("inherited", F.lit(0)).alias("inherited"))


def epoch_batches(spark, sf):
    """The first 1000 documents in hash order, in batches of 24."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).orderBy("h", "doc_id").limit(1000)
    return d.withColumn("nth", F.row_number().over(Window.orderBy("h", "doc_id"))).select("doc_id", F.floor((F.col("nth") - 1) / 24).alias("batch"))  # an epoch: 1000 rows


def line_token_digest(spark, sf):
    t = lines(table(spark, sf, "benchmark"), "text", "item_id").where(F.trim("line") != "")
    w = t.select("item_id", coding.line_tokens(coding.normalized_line(F.col("line"))).alias("w"))
    return w.groupBy("item_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("w")).alias("tokens"), F.sum(F.size(F.array_distinct("w"))).alias("kinds"))


def char_classes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", coding.control_count(F.col("text")).cast("long").alias("control"), coding.punctuation_count(F.col("text")).cast("long").alias("marks"),
                    coding.white_count(F.col("text")).cast("long").alias("white"), F.size(coding.whitespace_tokens(F.col("text"))).cast("long").alias("tokens"))


def inner_tokens(spark, sf):
    w = X.words(F.concat(F.lit("BOS "), "text", F.lit(" EOS")))
    return table(spark, sf, "benchmark").select("item_id", F.md5(F.array_join(coding.drop_sentinels(w), " ")).alias("inner_md5"))


def first_fields(spark, sf):
    head = F.substring_index("text", ". ", 1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(head).alias("head_md5"), F.size(F.split(F.trim(head), r"\s+", -1)).cast("long").alias("n"))


def lexeme_codes(spark, sf):
    """Each page's kinds of lexemes as one character each, and whether decoding gives them back."""
    p = with_tokens(table(spark, sf, "pages"), F.transform(lexers.lexemes(F.col("html")), lambda t: lexers.lexeme_kind(t)), "page_id")
    code = with_tokens(p, F.array(coding.charified(F.col("w"), KINDS)), "page_id", F.col("w").alias("kinds")).select("page_id", "kinds", F.get("w", F.lit(0)).alias("code"))
    return code.select("page_id", F.md5("code").alias("code_md5"), (coding.uncharified(F.col("code"), KINDS) == F.col("kinds")).alias("back"))


def headings(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(coding.tagged(F.col("html"), "h1"), " | ").alias("heading"))


def padded_turn_lengths(spark, sf):
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    return n.select("conv_id", F.array_join(coding.padded(F.transform("t", lambda x: x["n"]), 12), ",").alias("lengths"))


def whole_line_matches(spark, sf):
    found = lines(table(spark, sf, "documents"), "text", "doc_id").where(X.matches_whole(F.col("line"), r"[A-Z][a-z ,]*\."))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def terminal_ngrams(spark, sf):
    """Trigrams of lower-case words that are all among the 200 commonest words."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text")))
    grams = t.select(F.explode(X.ngrams(F.col("w"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    top = t.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(200).agg(F.collect_set("token").alias("terminals"))
    return grams.crossJoin(F.broadcast(top)).where(F.forall(F.split("gram", " "), lambda x: F.array_contains("terminals", x))).select("gram", "n").orderBy(F.desc("n"), "gram").limit(100)  # one row of 200 words


def single_lines(spark, sf):
    w = F.size(X.words(F.col("text")))
    return table(spark, sf, "documents").where(~F.contains(F.rtrim("text"), F.lit("\n")) & w.between(10, 15)).select("doc_id", w.cast("long").alias("n")).orderBy("doc_id").limit(100)


def selected_lines(spark, sf):
    """Lines by eight conditions: length, words, case, end, balance, digits, white space, repeats."""
    t = lines(table(spark, sf, "documents"), "text", "doc_id").withColumn("l", F.trim("line"))
    l = F.col("l")  # noqa: E741
    kept = t.where(F.length(l).between(20, 80)).where(F.size(X.words(l)) >= 4).where(l.rlike("^[A-Z]")).where(F.endswith(l, F.lit("."))).where(X.bracket_balance(l) == 0)
    kept = kept.where(~l.rlike("[0-9]")).where(~F.contains(l, F.lit("  "))).where(F.size(F.array_distinct(X.words(l))) == F.size(X.words(l)))
    return kept.select("doc_id", F.col("line_no").cast("long"), F.md5("l").alias("line_md5"))


def seeded_matrix(spark, sf):
    return coding.random_matrix(spark, 20, 12).select("i", "j", F.round("x", 9).alias("x"))


def shared_synonyms(spark, sf):
    """Turn roles and languages have no thesaurus: words that follow the same commonest word count as synonyms, two steps deep."""
    t = with_tokens(table(spark, sf, "benchmark"), X.words(F.lower("text"))).select(F.explode(X.ngrams(F.col("w"), 2)).alias("g")).select(F.substring_index("g", " ", 1).alias("ctx"), F.substring_index("g", " ", -1).alias("word"))
    n = t.groupBy("ctx", "word").agg(F.count(F.lit(1)).alias("n"))
    top = stats.take_per_group(n, ["ctx"], 2, F.desc("n"), F.asc("word"))
    pairs = top.groupBy("ctx").agg(F.min("word").alias("word"), F.max("word").alias("synonym")).where("word <> synonym").select("word", "synonym").distinct()
    return coding.synonyms(pairs.select("word").distinct(), pairs, 2).groupBy("word", "steps").agg(F.count(F.lit(1)).alias("n")).select("word", F.col("steps").cast("long"), "n")


_LEX = lexers.LEXEME.replace("'", "''")
_FLAT = "array_to_string(regexp_extract_all(%s, '\\w+'), ' ')"
_BAL = " + ".join(f"(length(l) - length(replace(l, '{o}', ''))) - (length(l) - length(replace(l, '{c}', '')))" for o, c in ("()", "[]", "{}"))
_RES = ", ".join(f"'{w}'" for w in X.RESERVED)
_CHAR = " ".join(f"WHEN '{k}' THEN chr({coding.FIRST + i})" for i, k in enumerate(KINDS))
_KIND = f"""CASE WHEN substr(t, 1, 2) IN ('//', '/*') THEN 'comment' WHEN substr(t, 1, 1) IN ('"', '''') AND length(t) > 1 THEN 'string' WHEN regexp_matches(t, '^[0-9]') THEN 'number'
  WHEN t IN ({_RES}) THEN 'keyword' WHEN regexp_matches(t, '^[A-Za-z_$]') THEN 'name' WHEN regexp_matches(t, '^[ \\t\\r\\n]') THEN 'space' ELSE 'operator' END"""
_LINES = r"l AS (SELECT %s, unnest(range(len(string_split_regex(text, '\r\n|\n|\r')))) AS line_no, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM %s)"
_HOST = "h AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)"
_COMMENT = "(length(trim(x)) <= 1 OR substr(trim(x), 1, 2) IN ('//', '* ', '/*'))"
_LT = r"regexp_extract_all(rtrim(line, ' ' || chr(9)), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\s\x0bA-Za-z0-9]')"
QUERIES = {f.__name__: f for f in (
    hash_lookup, balanced_records, hosts_without_copies, page_badges, repository_listing, method_stats, type_inheritance, epoch_batches, line_token_digest, char_classes, inner_tokens, first_fields,
    lexeme_codes, headings, padded_turn_lengths, whole_line_matches, terminal_ngrams, single_lines, selected_lines, seeded_matrix, shared_synonyms)}
ORACLE_SQL = {
    "hash_lookup": """WITH w AS (SELECT md5(url) AS hash FROM pages UNION ALL SELECT md5(text) FROM benchmark), i AS (SELECT md5(url) AS hash, min(url) AS uri FROM pages GROUP BY 1)
        SELECT coalesce(uri, 'MISSING') AS uri, count(*) AS n FROM w LEFT JOIN i USING (hash) GROUP BY 1""",
    "balanced_records": f"""WITH p AS (SELECT DISTINCT {_FLAT % 'a.text'} AS broken, {_FLAT % 'b.text'} AS fixed, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn = a.turn + 1),
        k AS (SELECT {_FLAT % 'text'} AS broken FROM conversations WHERE role = 'system'),
        s AS (SELECT *, len(string_split(broken, ' ')) // 10 * 10 AS bucket, abs(len(string_split(broken, ' ')) - len(string_split(fixed, ' '))) AS dist FROM p WHERE broken NOT IN (SELECT broken FROM k))
        SELECT bucket, dist, md5(x) AS broken_md5, md5(y) AS fixed_md5 FROM s QUALIFY row_number() OVER (PARTITION BY bucket, dist ORDER BY md5(broken || chr(10) || fixed), broken, fixed, x, y) <= 3""",
    "hosts_without_copies": f"""WITH {_HOST}, c AS (SELECT regexp_replace(host, '^(www|m|blog)\\.', '') AS host FROM h WHERE regexp_matches(host, '^(www|m|blog)\\.'))
        SELECT host, count(*) AS n FROM h WHERE NOT regexp_matches(host, '^(www|m|blog)\\.') AND host NOT IN (SELECT host FROM c) GROUP BY host""",
    "page_badges": """SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, CAST(sum(CASE WHEN contains(substr(html, 3501), '</article>') AND NOT contains(substr(html, 3501), '###') AND NOT contains(substr(html, 3501), '$$$') THEN 1 ELSE 0 END) AS BIGINT) AS admitted, count(*) AS n FROM pages GROUP BY 1""",
    "repository_listing": """WITH p AS (SELECT p_partkey || '-' || p_name AS name, p_partkey, p_size * 10 AS forks, p_partkey * 31 % 12000 AS size, p_partkey * 7919 % 100003 AS stars, p_partkey * 13 % 97 AS issues FROM part),
        t AS (SELECT * FROM p WHERE forks >= 100 AND size BETWEEN 1000 AND 10000 ORDER BY stars DESC, name LIMIT 200) SELECT name, stars, issues FROM t WHERE p_partkey % 3 <> 0 ORDER BY issues DESC, name""",
    "method_stats": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, len(regexp_extract_all(text, '\\w+')) AS n FROM documents)
        SELECT doc_id, len(l) AS lines, n AS tokens, round(n / len(l), 6) AS mean, CAST(coalesce(list_sum(list_transform(list_filter(l, lambda x: {_COMMENT}), lambda x: length(x))), 0) AS BIGINT) AS comment_chars,
          CAST(coalesce(list_sum(list_transform(list_filter(l, lambda x: NOT {_COMMENT}), lambda x: length(x))), 0) AS BIGINT) AS code_chars FROM d""",
    "type_inheritance": f"""WITH RECURSIVE {_HOST}, o AS (SELECT host, count(*) AS own FROM h WHERE host <> '' GROUP BY host),
        a AS (SELECT host, substr(host, instr(host, '.') + 1) AS up FROM o WHERE contains(host, '.') UNION SELECT host, substr(up, instr(up, '.') + 1) FROM a WHERE contains(up, '.')),
        i AS (SELECT a.host, count(*) AS supertypes, CAST(coalesce(sum(p.own), 0) AS BIGINT) AS inherited FROM a LEFT JOIN o p ON p.host = a.up GROUP BY a.host)
        SELECT host, own, coalesce(supertypes, 0) AS supertypes, coalesce(inherited, 0) AS inherited FROM o LEFT JOIN i USING (host)""",
    "epoch_batches": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM documents) SELECT doc_id, (nth - 1) // 24 AS batch FROM d WHERE nth <= 1000",
    "line_token_digest": f"""WITH {_LINES % ('item_id', 'benchmark')} SELECT item_id, count(*) AS lines, CAST(sum(len({_LT})) AS BIGINT) AS tokens,
        CAST(sum(len(list_distinct(list_transform({_LT}, lambda t: lower(t))))) AS BIGINT) AS kinds FROM l WHERE trim(line) <> '' GROUP BY item_id""",
    "char_classes": r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{Cc}\p{Cf}]')) - len(regexp_extract_all(text, '[\t\n\r]')) AS control,
        len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) + len(regexp_extract_all(text, '\p{P}')) - len(regexp_extract_all(text, '[!-#%-*,-/:;?@\[-\]_{}]')) AS marks,
        len(regexp_extract_all(text, '[ \t\n\r]|\p{Zs}')) - len(regexp_extract_all(text, ' ')) AS white, len(string_split(text, ' ')) AS tokens FROM documents""",
    "inner_tokens": f"SELECT item_id, md5({_FLAT % 'text'}) AS inner_md5 FROM benchmark",
    "first_fields": r"SELECT conv_id, turn, md5(split_part(text, '. ', 1)) AS head_md5, len(string_split_regex(trim(split_part(text, '. ', 1)), '\s+')) AS n FROM conversations",
    "lexeme_codes": f"""WITH t AS (SELECT page_id, regexp_extract_all(html, '{_LEX}') AS w FROM pages)
        SELECT page_id, md5('|' || array_to_string(list_transform(w, lambda t: CASE {_KIND} {_CHAR} END), '') || '}}') AS code_md5, true AS back FROM t""",
    "headings": "SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), ' | ') AS heading FROM pages",
    "padded_turn_lengths": "WITH t AS (SELECT conv_id, list(length(text) ORDER BY turn) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string((n || list_transform(range(12), lambda i: 0))[1:12], ',') AS lengths FROM t",
    "whole_line_matches": f"WITH {_LINES % ('doc_id', 'documents')} SELECT doc_id, count(*) AS n FROM l WHERE regexp_full_match(line, '[A-Z][a-z ,]*\\.') GROUP BY doc_id",
    "terminal_ngrams": r"""WITH w AS (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM conversations), t AS (SELECT unnest(w) AS token FROM w), top AS (SELECT token FROM t GROUP BY token ORDER BY count(*) DESC, token LIMIT 200),
        g AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w), x AS (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS n FROM g GROUP BY ALL)
        SELECT a || ' ' || b || ' ' || c AS gram, n FROM x WHERE a IN (FROM top) AND b IN (FROM top) AND c IN (FROM top) ORDER BY n DESC, gram LIMIT 100""",
    "single_lines": r"SELECT doc_id, len(regexp_extract_all(text, '\w+')) AS n FROM documents WHERE NOT contains(rtrim(text, ' '), chr(10)) AND len(regexp_extract_all(text, '\w+')) BETWEEN 10 AND 15 ORDER BY doc_id LIMIT 100",
    "selected_lines": f"""WITH {_LINES % ('doc_id', 'documents')}, t AS (SELECT doc_id, line_no, trim(line) AS l, regexp_extract_all(trim(line), '\\w+') AS w FROM l)
        SELECT doc_id, line_no, md5(l) AS line_md5 FROM t WHERE length(l) BETWEEN 20 AND 80 AND len(w) >= 4 AND regexp_matches(l, '^[A-Z]') AND ends_with(l, '.') AND {_BAL} = 0
          AND NOT regexp_matches(l, '[0-9]') AND NOT contains(l, '  ') AND len(list_distinct(w)) = len(w)""",
    "seeded_matrix": "SELECT i, j, round(CAST('0x' || substr(md5('1-' || i || '-' || j), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE, 9) AS x FROM range(20) a(i), range(12) b(j)",
    "shared_synonyms": r"""WITH w AS (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM benchmark), g AS (SELECT w, unnest(range(1, len(w))) AS i FROM w), n AS (SELECT w[i] AS ctx, w[i + 1] AS word, count(*) AS n FROM g GROUP BY ALL),
        t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, word) <= 2), q AS (SELECT DISTINCT min(word) AS a, max(word) AS b FROM t GROUP BY ctx HAVING min(word) <> max(word)),
        e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), s AS (SELECT DISTINCT a AS word FROM q), o AS (SELECT s.word, e.b AS syn FROM s JOIN e ON e.a = s.word),
        o2 AS (SELECT DISTINCT o.word, e.b AS syn FROM o JOIN e ON e.a = o.syn WHERE e.b <> o.word), two AS (SELECT * FROM o2 EXCEPT SELECT * FROM o)
        SELECT word, 1::BIGINT AS steps, count(*) AS n FROM o GROUP BY word UNION ALL SELECT word, 2, count(*) FROM two GROUP BY word""",
}
