"""Data sets for training and evaluation: mined repositories, splits, masked instances, vocabularies, brackets, pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexers, sequences, text as X, trees
from ..operators import stats
from ..operators.automata import grammar_distance
from ..sources import corpus, records
from ..sources.corpus import table, with_tokens
from .evaluation import DIALOGUE, _roles
from .structure import statements


def mined_repositories(spark, sf):
    """Owners and names mined from the page addresses, each name once and each owner once, without mirrors and without what prefixed hosts hold."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("url", F.lit(r"^https?://([^/?#]+)/([^?#]*)"), 1).alias("o"), F.regexp_extract_all("url", F.lit(r"^https?://([^/?#]+)/([^?#]*)"), 2).alias("n"))
    p = p.select("page_id", F.get("o", F.lit(0)).alias("owner"), F.get("n", F.lit(0)).alias("name")).where("name <> ''")
    own, prefixed = p.where(~F.col("owner").rlike(r"^(www|m|blog)\.")), p.where(F.col("owner").rlike(r"^(www|m|blog)\."))
    first = stats.take_per_group(own, ["name"], 1, F.col("page_id"))
    first = stats.take_per_group(first, ["owner"], 1, F.col("page_id"))
    return records.without_copies(first, prefixed.select("name"), "name").where(~F.contains("name", F.lit("mirror"))).select("owner", "name")


def documentation_split(spark, sf):
    ls = F.split("text", "\n", -1)
    d = table(spark, sf, "documents").select("doc_id", X.documentation(ls).alias("doc"), X.code_lines(ls).alias("code"))
    return d.select("doc_id", F.size("doc").cast("long").alias("docs"), F.size("code").cast("long").alias("code"), F.md5(F.coalesce(F.get("doc", F.lit(0)), F.lit(""))).alias("first_md5"))


def popular_productions(spark, sf):
    """Bigrams of the turns, kept if doubled, or met more than ten times in the documents' commonest thousand; those not counted there stay."""
    grams = lambda t: with_tokens(table(spark, sf, t), X.words(F.lower("text"))).select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    known = grams("documents").orderBy(F.desc("n"), "gram").limit(1000).select("gram", F.col("n").alias("seen"))
    rows = grams("conversations").join(F.broadcast(known), "gram", "left")  # 1000 rows
    doubled = F.substring_index("gram", " ", 1) == F.substring_index("gram", " ", -1)
    return rows.where(doubled | (F.coalesce("seen", F.lit(11)) > 10)).select("gram", "n")


def dialogue_membership(spark, sf):
    """Conversations whose roles are a dialogue of the grammar."""
    return _roles(spark, sf).groupBy((grammar_distance(F.col("roles"), DIALOGUE) == 0).alias("member")).agg(F.count(F.lit(1)).alias("n"))


def _turn_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    n = F.size(X.words(F.col("text"))).cast("long")
    return c.select("conv_id", "turn", F.col("text").alias("a"), n.alias("na")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"), n.alias("nb")), ["conv_id", "turn"])


def balanced_split(spark, sf):
    """Adjacent turns in buckets of length and difference: five of each validate, the rest train; sides joined back to their texts."""
    p = _turn_pairs(spark, sf).select("conv_id", "turn", F.floor(F.col("na") / 10).alias("tens"), F.floor(F.abs(F.col("na") - F.col("nb")) / 5).alias("dist"), F.md5(F.concat_ws("-", "conv_id", "turn")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("tens", "dist").orderBy("h"))
    side = p.select("conv_id", "turn", F.when(nth <= 5, "valid").otherwise("train").alias("side"))
    return side.join(table(spark, sf, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "side", F.md5("text").alias("text_md5"))


def masked_brackets(spark, sf):
    """Pages with two of their brackets masked, or dropped, by hash; and cut after the last opening one."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1).alias("s"))
    seed = F.col("page_id").cast("string")
    return p.select("page_id", X.brackets_replaced(F.col("s"), seed, 2, "<mask>").alias("masked"), X.brackets_replaced(F.col("s"), seed, 1, "").alias("dropped"), X.until_last_call(F.col("s")).alias("cut"))


def exchanged_sides(spark, sf):
    """Adjacent pairs of sentence pairs; in half of them, by hash, the first sides change places and no longer belong together."""
    c = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("p"), F.col("turn") % 2 == 0, "text").toDF("conv_id", "p", "even", "text")
    s = c.groupBy("conv_id", "p").agg(F.max(F.when(F.col("even"), F.col("text"))).alias("a"), F.max(F.when(~F.col("even"), F.col("text"))).alias("b")).where("a is not null and b is not null")
    other = s.select("conv_id", F.when(F.col("p") % 2 == 0, F.col("p") + 1).otherwise(F.col("p") - 1).alias("p"), F.col("a").alias("o"))
    s = s.join(other, ["conv_id", "p"], "left").withColumn("pick", F.conv(F.substring(F.md5(F.concat_ws("-", "conv_id", F.floor(F.col("p") / 2))), 1, 4), 16, 10).cast("long") % 2)
    swapped = F.col("o").isNotNull() & (F.col("pick") == 1)
    return s.select("conv_id", "p", (~swapped).alias("consecutive"), F.md5(F.concat(F.when(swapped, F.col("o")).otherwise(F.col("a")), F.lit("\n"), "b")).alias("pair_md5"))


def masked_instances(spark, sf):
    """Sentence pairs between [CLS] and [SEP], cut and padded to 128 tokens: a fifth masked by hash, with segment numbers and the mask's places."""
    p = _turn_pairs(spark, sf).select("conv_id", "turn", X.words(F.lower("a")).alias("a"), X.words(F.lower("b")).alias("b"))
    cls, sep = (F.array(F.lit(t)) for t in ("[CLS]", "[SEP]"))
    t = p.select("conv_id", "turn", F.slice(F.concat(cls, "a", sep, "b", sep), 1, 128).alias("t"), (F.size("a") + 2).alias("border"))
    t = t.withColumn("h", F.transform("t", lambda x, i: F.when(~x.isin("[CLS]", "[SEP]"), F.md5(F.concat_ws("-", "conv_id", "turn", i)))))
    n = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.size("t") / 5).cast("int")))
    t = t.withColumn("picked", F.slice(F.array_sort(F.filter("h", lambda h: h.isNotNull())), F.lit(1), n))
    masked = F.transform("t", lambda x, i: F.when(F.array_contains("picked", F.get("h", i)), F.lit("[MASK]")).otherwise(x))
    types = F.transform("t", lambda x, i: (i >= F.col("border")).cast("int"))
    padded = F.concat(masked, F.array_repeat(F.lit("[PAD]"), 128 - F.size("t")))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.size("picked").cast("long").alias("n_masked"), F.md5(F.array_join(padded, " ")).alias("tokens_md5"), F.aggregate(types, F.lit(0), lambda s, x: s + x).cast("long").alias("second"))


def vocabulary_round_trip(spark, sf):
    """Items as places in the vocabulary of the 300 commonest words, and decoded again."""
    t = with_tokens(table(spark, sf, "benchmark"), X.words(F.lower("text")), "item_id")
    words = t.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(300)
    vocabulary = ["[UNK]", *[r["token"] for r in words.collect()]]  # 300 words
    ids = t.select("item_id", F.explode(F.array(lexers.vocabulary_ids(F.col("w"), vocabulary))).alias("ids"))
    return ids.select("item_id", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5(F.array_join(lexers.vocabulary_tokens(F.col("ids"), vocabulary), " ")).alias("words_md5"))


def reranked_documents(spark, sf):
    """Documents by the share of their words that the first item holds, best first."""
    q = table(spark, sf, "benchmark").where("item_id = 0").select(F.array_distinct(X.words(F.lower("text"))).alias("q"))
    d = with_tokens(table(spark, sf, "documents"), F.array_distinct(X.words(F.lower("text"))), "doc_id").crossJoin(F.broadcast(q))  # one row
    score = F.round(F.size(F.array_intersect("w", "q")) / F.greatest(F.size("w"), F.lit(1)), 6)
    return d.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def small_repairs(spark, sf):
    """Adjacent turns as 2-line records of 5 to 60 words whose lengths differ by ten at most."""
    flat = lambda c: F.array_join(X.words(F.col(c)), " ")
    rows = _turn_pairs(spark, sf).select("conv_id", "turn", flat("a").alias("first"), flat("b").alias("second"))
    size = lambda c: F.size(F.split(c, " "))
    kept = corpus.small_repairs(rows, (5, 60), F.lit(10), F.abs(size("first") - size("second")))
    return kept.select("conv_id", "turn")


def scored_rewrites(spark, sf):
    """Each rewrite of the turns that changes them: share of neighbouring words that the original turns hold too, by role."""
    c = table(spark, sf, "conversations").select("role", "text")
    txs = {"lower": F.lower("text"), "visible": X.visible_chars(F.col("text")), "plus": F.replace("text", F.lit("."), F.lit(" +"))}
    each = c.select("role", "text", F.explode(F.array(*[F.struct(F.lit(k).alias("sct"), v.alias("variant")) for k, v in txs.items()])).alias("x")).select("role", "text", "x.*").where("text <> variant")
    known = with_tokens(c, X.words(F.col("text"))).select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram")).distinct().withColumn("known", F.lit(1))
    grams = with_tokens(each, X.words(F.col("variant")), "role", "sct").select("role", "sct", F.explode(X.ngrams(F.col("w"), 2)).alias("gram"))
    hit = grams.join(known, "gram", "left").groupBy("role", "sct").agg(F.avg(F.coalesce("known", F.lit(0))).alias("s"))
    return hit.groupBy("role").pivot("sct", sorted(txs)).agg(F.round(F.first("s"), 6))


def pair_codes(spark, sf):
    """Each turn and the next as one row of 512 character codes, the model's input length, cut or padded."""
    ascii_ = lambda c: X.visible_chars(F.col(c))
    codes = corpus.query_with_document(ascii_("a"), ascii_("b"), 512)
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.array_join(codes, ",").alias("codes"))


def statement_productions(spark, sf):
    """Kinds of a node, two neighbouring children and the first child of each, over all statements."""
    t = statements(spark, sf).select("n", F.explode(F.array(trees.tree_nodes(F.col("source")))).alias("t"))
    kids = t.select("n", "t", F.posexplode("t").alias("i", "a"))
    two = kids.select("n", "t", "i", "a", F.get("t", F.col("i") + 1).alias("b")).where("a.parent = b.parent")
    first = lambda at: F.coalesce(F.get(F.filter("t", lambda x: x["parent"] == at), F.lit(0))["kind"], F.lit(""))
    q = two.select("n", F.get("t", F.col("a.parent"))["kind"].alias("head"), F.col("a.kind").alias("left"), F.col("b.kind").alias("right"), first(F.col("a.id")).alias("left_first"), first(F.col("b.id")).alias("right_first"))
    return q.groupBy("head", "left", "right", "left_first", "right_first").agg(F.sum("n").alias("n"))


def statement_lexing(spark, sf):
    """Statements as kinds of tokens, rendered anew: whether the rendering still parses and has the same kinds."""
    s = statements(spark, sf).select("n", F.explode(F.array(lexers.python_kinds(lexers.python_tokens(F.col("source"))))).alias("k"))
    r = s.select("n", "k", F.explode(F.array(lexers.rendered_python(F.col("k")))).alias("source"))
    back = lexers.python_kinds(lexers.python_tokens(F.col("source")))
    return r.groupBy(sequences.python_error(F.col("source")).isNull().alias("parses"), (back == F.col("k")).alias("same")).agg(F.sum("n").alias("n"))


def error_places(spark, sf):
    """Tenth of a statement at which reading fails if its last bracket is missing."""
    s = statements(spark, sf).select("n", F.regexp_replace("source", r"(?s)[)\]}]([^)\]}]*)$", "$1").alias("source"))
    at = s.select("n", (sequences.python_error_place(F.col("source")) * 10 / F.length("source")).cast("long").alias("tenth"))
    return at.groupBy("tenth").agg(F.sum("n").alias("n"))


def label_set_distances(spark, sf):
    """Smallest and earth mover's distance between the ten vectors of smallest hash of each two labels."""
    e = stats.take_per_group(table(spark, sf, "embeddings").select("label", "embedding", "vec_id"), ["label"], 10, F.md5(F.col("vec_id").cast("string")))
    g = e.groupBy("label").agg(F.array_sort(F.collect_list(F.transform("embedding", lambda x: x.cast("double")))).alias("v"))  # ten each
    both = g.join(g.select(F.col("label").alias("other"), F.col("v").alias("w")), F.col("label") < F.col("other"))
    return both.select("label", "other", F.explode(F.array(sequences.point_set_distances(F.col("v"), F.col("w")))).alias("d")).select("label", "other", F.round("d.least", 6).alias("least"), F.round("d.mover", 6).alias("mover"))


_SCRIPT = "regexp_extract(html, '(?s)<script>(.*?)</script>', 1)"
_PAIRS = r"""p AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b, regexp_extract_all(a.text, '\w+') AS wa, regexp_extract_all(b.text, '\w+') AS wb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_DOC = "(length(trim(x)) > 1 AND substr(trim(x), 1, 2) IN ('//', '* ', '/*'))"
QUERIES = {f.__name__: f for f in (
    mined_repositories, documentation_split, popular_productions, dialogue_membership, balanced_split, masked_brackets, exchanged_sides, masked_instances, vocabulary_round_trip, reranked_documents,
    small_repairs, scored_rewrites, pair_codes, statement_productions, statement_lexing, error_places, label_set_distances)}
ORACLE_SQL = {
    "mined_repositories": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)/([^?#]*)', 1) AS owner, regexp_extract(url, '^https?://([^/?#]+)/([^?#]*)', 2) AS name FROM pages), q AS (SELECT * FROM p WHERE name <> ''),
        f AS (SELECT * FROM q WHERE NOT regexp_matches(owner, '^(www|m|blog)\.') QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id) = 1),
        g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY page_id) = 1)
        SELECT owner, name FROM g WHERE name NOT IN (SELECT name FROM q WHERE regexp_matches(owner, '^(www|m|blog)\.')) AND NOT contains(name, 'mirror')""",
    "documentation_split": f"""WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {_DOC}) AS d, list_filter(string_split(text, chr(10)), lambda x: NOT {_DOC}) AS c FROM documents)
        SELECT doc_id, len(d) AS docs, len(c) AS code, md5(coalesce(d[1], '')) AS first_md5 FROM d""",
    "popular_productions": r"""WITH w AS (SELECT 'd' AS k, regexp_extract_all(lower(text), '\w+') AS w FROM documents UNION ALL SELECT 'c', regexp_extract_all(lower(text), '\w+') FROM conversations), i AS (SELECT k, w, unnest(range(1, len(w))) AS i FROM w),
        g AS (SELECT k, w[i] AS a, w[i + 1] AS b, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM i GROUP BY ALL), s AS (SELECT gram, n AS seen FROM g WHERE k = 'd' ORDER BY n DESC, gram LIMIT 1000)
        SELECT gram, n FROM g LEFT JOIN s USING (gram) WHERE k = 'c' AND (a = b OR coalesce(seen, 11) > 10)""",
    "dialogue_membership": "WITH c AS (SELECT conv_id, string_agg(role, ' ' ORDER BY turn) || ' ' AS r FROM conversations GROUP BY conv_id) SELECT regexp_full_match(r, '(system )?(user assistant )+') AS member, count(*) AS n FROM c GROUP BY 1",
    "balanced_split": f"""WITH {_PAIRS}, b AS (SELECT conv_id, turn, a, len(wa) // 10 AS tens, abs(len(wa) - len(wb)) // 5 AS dist FROM p)
        SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY tens, dist ORDER BY md5(conv_id || '-' || turn)) <= 5 THEN 'valid' ELSE 'train' END AS side, md5(a) AS text_md5 FROM b""",
    "masked_brackets": f"""WITH p AS (SELECT page_id, {_SCRIPT} AS s FROM pages), c AS (SELECT page_id, s, unnest(range(length(s))) AS i, unnest(regexp_extract_all(s, '(?s).')) AS c FROM p),
        h AS (SELECT *, c IN ('(', ')', '[', ']', '{{', '}}') AS br, md5(page_id || '-' || i) AS h FROM c), r AS (SELECT *, CASE WHEN br THEN row_number() OVER (PARTITION BY page_id, br ORDER BY h) END AS nth FROM h)
        SELECT page_id, string_agg(CASE WHEN nth <= 2 THEN '<mask>' ELSE c END, '' ORDER BY i) AS masked, string_agg(CASE WHEN nth <= 1 THEN '' ELSE c END, '' ORDER BY i) AS dropped,
          any_value(CASE WHEN contains(s, '(') THEN substr(s, 1, length(s) - length(split_part(s, '(', -1))) ELSE s END) AS cut FROM r GROUP BY page_id""",
    "exchanged_sides": """WITH s AS (SELECT conv_id, turn // 2 AS p, max(text) FILTER (WHERE turn % 2 = 0) AS a, max(text) FILTER (WHERE turn % 2 = 1) AS b FROM conversations GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL),
        x AS (SELECT s.*, o.a AS o, CAST('0x' || substr(md5(s.conv_id || '-' || s.p // 2), 1, 4) AS BIGINT) % 2 = 1 AND o.a IS NOT NULL AS sw FROM s LEFT JOIN s o ON o.conv_id = s.conv_id AND o.p = CASE WHEN s.p % 2 = 0 THEN s.p + 1 ELSE s.p - 1 END)
        SELECT conv_id, p, NOT sw AS consecutive, md5(CASE WHEN sw THEN o ELSE a END || chr(10) || b) AS pair_md5 FROM x""",
    "masked_instances": r"""WITH q AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '\w+') AS a, regexp_extract_all(lower(b.text), '\w+') AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
        t AS (SELECT conv_id, turn, (['[CLS]'] || a || ['[SEP]'] || b || ['[SEP]'])[1:128] AS t, len(a) + 2 AS border FROM q), i AS (SELECT *, len(t) AS n, unnest(range(len(t))) AS i, unnest(t) AS x FROM t),
        h AS (SELECT *, x NOT IN ('[CLS]', '[SEP]') AS own, md5(conv_id || '-' || turn || '-' || i) AS h FROM i), r AS (SELECT *, own AND row_number() OVER (PARTITION BY conv_id, turn, own ORDER BY h) <= least(20, greatest(1, n // 5)) AS m FROM h)
        SELECT conv_id, turn, max(n) AS n, count(*) FILTER (WHERE m) AS n_masked, md5(string_agg(CASE WHEN m THEN '[MASK]' ELSE x END, ' ' ORDER BY i) || repeat(' [PAD]', CAST(128 - max(n) AS INTEGER))) AS tokens_md5,
          count(*) FILTER (WHERE i >= border) AS second FROM r GROUP BY conv_id, turn""",
    "vocabulary_round_trip": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '\w+') AS w FROM benchmark), i AS (SELECT item_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM w),
        v AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) AS id FROM i GROUP BY t QUALIFY id <= 300)
        SELECT item_id, md5(string_agg(coalesce(id, 0), ',' ORDER BY i)) AS ids_md5, md5(string_agg(CASE WHEN id IS NULL THEN '[UNK]' ELSE t END, ' ' ORDER BY i)) AS words_md5 FROM i LEFT JOIN v USING (t) GROUP BY item_id""",
    "reranked_documents": r"""WITH q AS (SELECT regexp_extract_all(lower(text), '\w+') AS q FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\w+')) AS w FROM documents)
        SELECT doc_id, round(len(list_filter(w, lambda t: list_contains(q, t))) / greatest(len(w), 1), 6) AS score FROM d, q ORDER BY score DESC, doc_id LIMIT 50""",
    "small_repairs": f"WITH {_PAIRS} SELECT conv_id, turn FROM p WHERE greatest(len(wa), 1) BETWEEN 5 AND 60 AND abs(greatest(len(wa), 1) - greatest(len(wb), 1)) <= 10",
    "scored_rewrites": r"""WITH x AS (SELECT role, 'lower' AS sct, text, lower(text) AS v FROM conversations UNION ALL SELECT role, 'visible', text, regexp_replace(text, '[^!-~]', '', 'g') FROM conversations UNION ALL SELECT role, 'plus', text, replace(text, '.', ' +') FROM conversations),
        w AS (SELECT role, sct, regexp_extract_all(v, '\w+') AS w FROM x WHERE v <> text), g AS (SELECT role, sct, w, unnest(range(1, len(w))) AS i FROM w),
        k AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(text, '\w+') AS w FROM conversations))),
        s AS (SELECT role, sct, avg(CASE WHEN k.gram IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) AS s FROM g LEFT JOIN k ON k.gram = w[i] || ' ' || w[i + 1] GROUP BY role, sct)
        SELECT role, round(max(s) FILTER (WHERE sct = 'lower'), 6) AS lower, round(max(s) FILTER (WHERE sct = 'plus'), 6) AS plus, round(max(s) FILTER (WHERE sct = 'visible'), 6) AS visible FROM s GROUP BY role""",
    "pair_codes": f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, regexp_replace(a, '[^!-~]', '', 'g') || '|' || regexp_replace(b, '[^!-~]', '', 'g') AS t FROM p)
        SELECT conv_id, turn, array_to_string((list_transform(regexp_extract_all(t, '(?s).'), lambda c: ascii(c) % 256) || list_transform(range(512), lambda i: 0))[1:512], ',') AS codes FROM t""",
}
