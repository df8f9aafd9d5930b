"""Line dedup with a log-template tree, DataFrame functions only.

Each line walks a tree of fixed depth: first its token count, then its leading tokens.  Below that, fields are
generalised: tokens that hold a digit become ``<*>``, and the line offers one template for each quarter of its body
(of a body under four tokens, for each token) with that quarter generalised, at every length alike.  So lines whose
differences lie in one quarter share a template, and lines of one template agree in three quarters of their tokens.
Of the templates that occur in two or more documents a line takes one: that of most lines, ties to the first quarter.
The lines that took a template stay in the document with the smallest id and go from all others, so whatever goes
leaves a relative that stays.

Templates are 96-bit hashes with a document id; no line text is shuffled to find them, hot templates are
pre-aggregated to one (min, max, count) per task, and joining them back is a plain join whose hot keys Spark splits.

Edge cases: rows of one doc_id, and all rows of null doc_id, are one document; a null text stays null; blank lines
always stay; lines of up to ``DEPTH`` tokens match as a whole, lines of fields alone as they are; a text that loses no
line is returned unchanged, otherwise its lines are joined by ``\\n``; repeated rows lose the same lines.  Columns
beside doc_id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, stored, table

DEPTH = 3
MIN_TOKENS = 1
QUARTERS = 4
_BLANK = " \t\n\x0b\f\r"


def _split_lines(text: Column) -> Column:
    """Lines of a text; \\r\\n, \\n and \\r end a line."""
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return F.split(text, "\n", -1)


def _masked(line: Column) -> Column:
    field = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, field, "<*>")).otherwise(line)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column behind a generator, so that the optimizer doesn't copy its expression into each later use."""
    return df.select("d", "h", "pos", F.explode(F.array(value)).alias(name))


def _lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(d, h, pos, tokens) of the lines with at least min_tokens tokens, blank lines never."""
    # hashed below the generator: beside it, the whole text would be hashed again for each of its lines
    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"), "text")
    lines = named.select("d", "h", F.posexplode(_split_lines(F.col("text"))).alias("pos", "line"))
    words = lambda line: F.split(F.btrim(line, F.lit(_BLANK)), WHITE)
    both = lines.select("d", "h", "pos", "line", F.explode(F.array(_masked(F.col("line")))).alias("masked"))  # masked once, not at each use
    bare = F.btrim(F.replace(F.col("masked"), F.lit("<*>"), F.lit("")), F.lit(_BLANK)) == ""  # fields alone say nothing once generalised: they must recur as they are
    tokens = words(F.when(bare, F.col("line")).otherwise(F.col("masked")))
    return _once(both, "tokens", tokens).where((F.size("tokens") >= min_tokens) & (F.get("tokens", F.lit(0)) != ""))


def _templates(lines: DataFrame) -> DataFrame:
    """(d, h, pos, j, a, b): a row for each template of each line, j being its general quarter."""
    tokens, n = F.col("tokens"), F.size("tokens")
    body = F.greatest(n - DEPTH, F.lit(0))
    at = [F.floor(body * j / QUARTERS).cast("int") + DEPTH for j in range(QUARTERS + 1)]
    parts = [F.slice(tokens, at[j] + 1, at[j + 1] - at[j]) for j in range(QUARTERS)]
    hashed = [F.xxhash64(n, F.slice(tokens, 1, DEPTH)).alias("lead"), body.alias("body")]
    hashed += [f(p).alias(f"{k}{j}") for k, f in (("a", F.xxhash64), ("b", F.hash)) for j, p in enumerate(parts)]
    once = _once(lines, "s", F.struct(*hashed))

    def key(j: int) -> Column:
        rest = [i for i in range(QUARTERS) if i != j]
        return F.struct(
            F.lit(j).alias("j"), F.xxhash64("s.lead", F.lit(j), *[f"s.a{i}" for i in rest]).alias("a"), F.hash("s.lead", F.lit(j), *[f"s.b{i}" for i in rest]).alias("b"))

    size = [F.floor(F.col("s.body") * (j + 1) / QUARTERS) > F.floor(F.col("s.body") * j / QUARTERS) for j in range(QUARTERS)]
    general = [F.when(size[j], key(j)) for j in range(QUARTERS)]  # an empty quarter generalises nothing
    whole = F.when(F.col("s.body") == 0, key(QUARTERS))
    return once.select("d", "h", "pos", F.inline(F.array(*general, whole)).alias("j", "a", "b")).where("j is not null")


def recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(d, h, positions): 0-based lines to drop, by document id and text hash."""
    keys = stored(_templates(_lines(docs, min_tokens)), "line-templates")
    recur = keys.groupBy("a", "b").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("a", "b", "n")
    offers = keys.join(recur, ["a", "b"])
    taken = offers.groupBy("d", "h", "pos").agg(F.max(F.struct("n", (-F.col("j")).alias("j"), "a", "b")).alias("t"))
    taken = stored(taken.select("d", "h", "pos", "t.a", "t.b"), "line-template")  # read twice below
    least = taken.groupBy("a", "b").agg(F.min("d").alias("least"))
    gone = taken.join(least, ["a", "b"]).where("d > least")
    return gone.groupBy("d", "h").agg(F.collect_list("pos").alias("positions"))


def drop_recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents with ``text`` rewritten, plus n_lines and n_dropped (both int; they replace columns of those names)."""
    mine = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))
    both = mine.join(recurring_lines(docs, min_tokens), ["d", "h"], "left").withColumn("lines", _split_lines(F.col("row.text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))
    text = F.when(F.col("positions").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    counts = {k: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for k, c in (("n_lines", "lines"), ("n_dropped", "positions"))}
    out = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in counts]
    return both.select(*out, *[v.alias(k) for k, v in counts.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.md5("text").alias("text_md5"))


#: The same rows by string templates instead of hashes.
OP1_SQL = r"""
WITH l AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS d, md5(coalesce(text, 'null')) AS h,
         unnest(range(len(string_split_regex(text, '\r\n|\n|\r')))) AS pos,
         unnest(string_split_regex(text, '\r\n|\n|\r')) AS line
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT d, h, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own,
         regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS tk FROM l),
m AS (SELECT d, h, pos, CASE WHEN trim(replace(array_to_string(tk, ' '), '<*>', '')) = '' THEN own ELSE tk END AS tk FROM w WHERE len(tk) >= 1),
q AS (SELECT *, len(tk) AS n, 3 + (len(tk) - 3) * 1 // 4 AS p1, 3 + (len(tk) - 3) * 2 // 4 AS p2, 3 + (len(tk) - 3) * 3 // 4 AS p3 FROM m),
o AS (
  SELECT d, h, pos, n, unnest(CASE WHEN n > 3 THEN [0, 1, 2, 3] ELSE [4] END) AS j, unnest(CASE WHEN n > 3 THEN [p1 > 3, p2 > p1, p3 > p2, n > p3] ELSE [true] END) AS fine,
    unnest(CASE WHEN n > 3 THEN [
    array_to_string(tk[1:3], ' ') || ' * ' || array_to_string(tk[p1+1:n], ' '),
    array_to_string(tk[1:p1], ' ') || ' * ' || array_to_string(tk[p2+1:n], ' '),
    array_to_string(tk[1:p2], ' ') || ' * ' || array_to_string(tk[p3+1:n], ' '),
    array_to_string(tk[1:p3], ' ') || ' *']
    ELSE [array_to_string(tk, ' ')] END) AS t FROM q),
k AS (SELECT d, h, pos, j, j || ' ' || n || ' ' || t AS t FROM o WHERE fine),
r AS (SELECT t, count(*) AS n FROM k GROUP BY t HAVING min(d) < max(d)),
x1 AS (SELECT k.d, k.h, k.pos, k.t, row_number() OVER (PARTITION BY k.d, k.h, k.pos ORDER BY r.n DESC, k.j) AS nth FROM k JOIN r USING (t)),
tk1 AS (SELECT * FROM x1 WHERE nth = 1),
ls AS (SELECT t, min(d) AS least FROM tk1 GROUP BY t),
g AS (SELECT tk1.d, tk1.h, tk1.pos FROM tk1 JOIN ls USING (t) WHERE tk1.d > ls.least),
c AS (SELECT d, h, count(*) AS n_dropped FROM g GROUP BY d, h),
u AS (SELECT DISTINCT d, h, pos, line FROM l),
kept AS (SELECT u.d, u.h, string_agg(line, chr(10) ORDER BY u.pos) AS text
  FROM u LEFT JOIN g ON u.d = g.d AND u.h = g.h AND u.pos = g.pos WHERE g.d IS NULL GROUP BY u.d, u.h)
SELECT doc_id, CAST(coalesce(len(string_split_regex(x.text, '\r\n|\n|\r')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped,
       md5(CASE WHEN c.n_dropped IS NULL THEN x.text ELSE coalesce(kept.text, '') END) AS text_md5
FROM documents x LEFT JOIN c ON c.d = coalesce(x.doc_id, -9223372036854775808) AND c.h = md5(coalesce(x.text, 'null'))
LEFT JOIN kept ON kept.d = coalesce(x.doc_id, -9223372036854775808) AND kept.h = md5(coalesce(x.text, 'null'))
"""
