"""Grammars, automata, trees, graphs and pair queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import rewrites as R, sequences, text as X, trees
from ..operators import edits, experiments, graphs, pairs, parsing, ranking
from ..operators.automata import grammar_distance
from ..operators.stats import take_per_group
from ..sources.corpus import table, with_tokens
from .evaluation import DIALOGUE, _roles
from .repairs import ORACLE_SQL as REPAIR_SQL
from .repairs import _pairs

#: Roles of dialogues that the bigram model and the automaton are learnt from: fixed values.
DIALOGUES = [["user", "assistant"], ["user", "assistant"] * 2, ["system", "user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["user", "assistant"] * 3]


def host_links(spark, sf):
    """Three rounds of messages between hosts and the languages of their pages, from each one's number of pages."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    nodes = p.groupBy(F.col("host").alias("node")).agg(F.count(F.lit(1)).alias("x")).unionByName(p.groupBy(F.concat(F.lit("lang:"), "lang").alias("node")).agg(F.count(F.lit(1)).alias("x")))
    one = p.select(F.col("host").alias("src"), F.concat(F.lit("lang:"), "lang").alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graphs.message_passing(nodes, both, 3).select("node", F.round("x", 3).alias("x"))


def dialogue_symbols(spark, sf):
    """In how many spans of all conversations' roles each symbol of the dialogue grammar derives something."""
    def run(batch):
        return pa.array([sorted(parsing.active_symbols(DIALOGUE, t).elements()) for t in batch.to_pylist()], pa.list_(pa.string()))

    symbols = _roles(spark, sf).select(F.explode(F.arrow_udf(run, "array<string>")(F.col("roles"))).alias("symbol"))
    return symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def dialogue_scores(spark, sf):
    """Negative log-score of each conversation's roles under a bigram model, and under its weighted automaton."""
    model = parsing.Bigrams.learnt(DIALOGUES)
    r = _roles(spark, sf)
    return r.select("conv_id", F.round(parsing.automaton_scores(F.col("roles"), model), 6).alias("bigrams"), F.round(parsing.automaton_scores(F.col("roles"), model.automaton()), 6).alias("automaton"))


def role_scores(spark, sf):
    """Negative log-score of each conversation's roles under the add-one bigrams of the fixed dialogues, by a join with the counts."""
    model = parsing.Bigrams.learnt(DIALOGUES)
    cost = spark.createDataFrame([(a, b, model.cost(a, b)) for a in ("<begin>", "user", "assistant", "system") for b in ("user", "assistant", "system", "<end>")], "a string, b string, cost double")
    padded = _roles(spark, sf).select("conv_id", F.concat(F.array(F.lit("<begin>")), "roles", F.array(F.lit("<end>"))).alias("p"))
    steps = padded.select("conv_id", F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s")).select("conv_id", "s.*")
    return steps.join(F.broadcast(cost), ["a", "b"]).groupBy("conv_id").agg(F.round(F.sum("cost"), 6).alias("score"))  # 16 rows


def dialogue_fixes(spark, sf):
    """The best repair of each conversation's roles: fewest edits, then the bigram model."""
    best = F.get(parsing.scored_repairs(F.col("roles"), DIALOGUE, parsing.Bigrams.learnt(DIALOGUES), most=1), F.lit(0))
    return _roles(spark, sf).select("conv_id", F.explode(F.array(best)).alias("b")).groupBy(F.col("b.edits").alias("edits")).agg(F.count(F.lit(1)).alias("n"))


def dialogue_holes(spark, sf):
    """How many dialogues agree with each conversation's roles if every third role is unknown."""
    holes = F.transform("roles", lambda r, i: F.when(i % 3 == 2, "_").otherwise(r))
    return _roles(spark, sf).select("conv_id", F.size(parsing.holes_filled(holes, DIALOGUE)).alias("fillings"))


def dialogue_languages(spark, sf):
    """Dialogues within the distance of each conversation's roles and one more."""
    d = experiments.language_sizes(F.col("roles"), DIALOGUE)
    r = _roles(spark, sf).groupBy("roles").agg(F.count(F.lit(1)).alias("n"))  # each sequence of roles once
    return r.select("n", F.explode(F.array(d)).alias("d")).groupBy("d.length", "d.distance", "d.size").agg(F.sum("n").alias("n"))


def restored_dialogues(spark, sf):
    """Dialogues corrupted out of the language and repaired: how many edits the repair takes, and whether it restores them."""
    fine = _roles(spark, sf).where(grammar_distance(F.col("roles"), DIALOGUE) == 0)
    return experiments.corrected(fine, "conv_id", "roles", DIALOGUE, parsing.Bigrams.learnt(DIALOGUES)).groupBy("edits", "restored").agg(F.count(F.lit(1)).alias("n"))


def tree_paths(spark, sf):
    """Paths between the leaves of Python statements made of each order's columns, by their kinds."""
    o = table(spark, sf, "orders").select(F.format_string("%s = price(%d, %.2f) if key > %d else [%d]", F.concat(F.lit("status_"), "o_orderstatus"), F.col("o_custkey"), "o_totalprice", "o_orderkey", F.col("o_custkey")).alias("source"))
    shapes = o.select(F.regexp_replace("source", "[0-9]+", "1").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # each shape is parsed once
    p = shapes.select("n", F.explode(trees.path_contexts(trees.tree_nodes(F.col("source")))).alias("p"))
    return p.groupBy("p.start", "p.path", "p.end").agg(F.sum("n").alias("n"))


def prompt_validity(spark, sf):
    """Python statements of all parts with three characters masked: how many still parse."""
    p = table(spark, sf, "part").select("p_partkey", F.format_string("x[%d] = f('%s', %d)", "p_partkey", "p_name", "p_size").alias("source"))
    masked = p.select(F.replace(R.mask_window(F.col("source"), R.seed("p_partkey")), F.lit("<mask>"), F.lit("@")).alias("prompt"))
    return masked.groupBy(sequences.python_error(F.col("prompt")).isNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def corrupted_items(spark, sf):
    """Up to ten corruptions of each item by the edits mined from neighbouring items: how many, and how far away."""
    mined = pairs.edit_table(edits.edit_counts(_pairs(spark, sf)), 1000)
    b = table(spark, sf, "benchmark").select("item_id", X.words(F.lower("text")).alias("w"))
    made = pairs.corruptions(b, "item_id", "w", mined).join(b, "item_id")
    return made.groupBy("item_id", F.size(sequences.edits(F.col("w"), F.col("broken"))).alias("edits")).agg(F.count(F.lit(1)).alias("n"))


def corruption_codes(spark, sf):
    """Alignment codes of each item's first corruption."""
    b = table(spark, sf, "benchmark").select("item_id", X.words(F.lower("text")).alias("w"))
    made = pairs.corruptions(b, "item_id", "w", per=1).join(b, "item_id")
    return made.select("item_id", sequences.aligned(F.col("w"), F.col("broken")).alias("codes"))


def preprocessed_turns(spark, sf):
    """Adjacent turns as pairs: a side is valid if its commas are even in number."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    rows = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("broke")).join(c.withColumnRenamed("text", "fixed"), ["conv_id", "turn"])
    out = pairs.preprocessed(rows, lambda t: X.count_of(t, ",") % 2 == 0, lambda t: X.words(F.lower(t)), max_patch=1000, lengths=(1, 1000), max_lines=3)
    return out.groupBy("n_edits").agg(F.count(F.lit(1)).alias("n"))


def token_gains(spark, sf):
    """Tokens that the fixes of neighbouring items put in, ε for those that they take out."""
    return pairs.new_token_counts(edits.edit_counts(_pairs(spark, sf))).orderBy(F.desc("n"), "token").limit(100)


def repair_precision(spark, sf):
    """Items without their middle word, any word of the vocabulary put back anywhere: precision at 1000 by tens of words left."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.words(F.lower("text")).alias("truth")).where(F.size("truth") >= 2)
    ranks = edits.insertion_ranks(b, F.floor(F.size("truth") / 2).cast("int")).join(b.select("id", (F.size("truth") - 1).alias("length")), "id")
    return ranking.precision_by_bucket(ranks, 1000, [F.floor(F.col("length") / 10).alias("tens")])


def choices(spark, sf):
    """Each turn's first word among the four commonest words of its role: where the truth stands."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.lower("text")), "conv_id", "turn", "role").where(F.size("w") > 0)
    n = t.select("role", F.explode("w").alias("word")).groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"))
    common = take_per_group(n, ["role"], 4, F.desc("n"), F.asc("word")).select("role", "word")
    items = t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "role", F.get("w", F.lit(0)).alias("truth"))
    out = pairs.multiple_choice(items, items.select("id", "role").join(F.broadcast(common), "role"), "id", "truth", "word")  # four words a role
    return out.select("id", F.size("choices").cast("long").alias("n"), F.col("answer").cast("long").alias("answer"))


_LANG = """p AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, 'lang:' || regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)"""
_ROUND = "r%d AS (SELECT n.node, n.x + coalesce((SELECT sum(m.x) FROM e JOIN r%d m ON m.node = e.src WHERE e.dst = n.node), 0) AS x FROM r%d n)"
QUERIES = {f.__name__: f for f in (
    host_links, dialogue_symbols, dialogue_scores, role_scores, dialogue_fixes, dialogue_holes, dialogue_languages, restored_dialogues, tree_paths, prompt_validity, corrupted_items, corruption_codes, preprocessed_turns, token_gains, repair_precision, choices)}
_MODEL = parsing.Bigrams.learnt(DIALOGUES)
_COSTS = ", ".join(f"('{a}', '{b}', {_MODEL.cost(a, b)!r}::DOUBLE)" for a in ("<begin>", "user", "assistant", "system") for b in ("user", "assistant", "system", "<end>"))
ORACLE_SQL = {
    "host_links": f"""WITH {_LANG}, e AS (SELECT DISTINCT host AS src, lang AS dst FROM p UNION SELECT DISTINCT lang, host FROM p),
        r0 AS (SELECT host AS node, count(*)::DOUBLE AS x FROM p GROUP BY 1 UNION ALL SELECT lang, count(*) FROM p GROUP BY 1), {", ".join(_ROUND % (i, i - 1, i - 1) for i in (1, 2, 3))}
        SELECT node, round(x, 3) AS x FROM r3""",
    "role_scores": f"""WITH t AS (SELECT conv_id, ['<begin>'] || list(role ORDER BY turn) || ['<end>'] AS p FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, p, unnest(range(1, len(p))) AS i FROM t),
        c AS (SELECT * FROM (VALUES {_COSTS}) v(a, b, cost)) SELECT conv_id, round(sum(cost), 6) AS score FROM s JOIN c ON c.a = p[i] AND c.b = p[i + 1] GROUP BY conv_id""",
    "repair_precision": REPAIR_SQL["repair_rank"].split("SELECT count(*) AS n, round")[0].replace(" AS rk FROM q", " AS rk, len(q.x) // 10 AS tens FROM q") + """,
        cnt AS (SELECT tens, count(*) FILTER (WHERE rk < 1000) AS pos, count(*) FILTER (WHERE rk >= 1000) AS high, 0 AS neg FROM z GROUP BY tens)
        SELECT *, round(pos / (pos + high + neg + 1), 6) AS precision FROM cnt""",
    "choices": r"""WITH t AS (SELECT conv_id || ':' || turn AS id, role, regexp_extract_all(lower(text), '\w+') AS w FROM conversations), i AS (SELECT * FROM t WHERE len(w) > 0),
        n AS (SELECT role, word, count(*) AS n FROM (SELECT role, unnest(w) AS word FROM i) GROUP BY ALL), c AS (SELECT role, word FROM n QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, word) <= 4),
        x AS (SELECT id, w[1] AS c, true AS own FROM i UNION ALL SELECT id, word, false FROM i JOIN c USING (role)), d AS (SELECT id, c, bool_or(own) AS own FROM x GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(id || '-' || c), c) - 1 AS place FROM d)
        SELECT id, count(*) AS n, max(place) FILTER (WHERE own) AS answer FROM r GROUP BY id""",
}
