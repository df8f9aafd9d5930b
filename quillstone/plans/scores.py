"""Evaluation tables over trials; order lines stand for trials: length, distance, rank of the truth (-1: absent), time, model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking, stats
from ..sources.corpus import table, with_tokens


def trials(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("sample"), F.col("l_quantity").cast("long").alias("length"), F.col("l_linenumber").cast("long").alias("dist"),
        F.when(F.col("l_suppkey") % 5 == 0, -1).otherwise(F.col("l_partkey") % 40).cast("long").alias("rank0"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 101) % 12000).alias("ms"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"),
        (F.col("l_suppkey") % 11 == 0).alias("failed"), "l_partkey", "l_suppkey")


def precision_by_length_distance(spark, sf):
    return ranking.precision_by_bucket(trials(spark, sf), 20, [F.floor(F.col("length") / 10).alias("tens"), F.col("dist")])


def precision_by_time(spark, sf):
    return ranking.precision_by_time(trials(spark, sf).where("dist = 2"))


def timed_rank_statistics(spark, sf):
    """Events of a user are the proposals of a sample, purchases the hits."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("place"), (F.col("event_id") * 7919 % 10000).alias("ms"), (F.col("event_type") == "purchase").alias("hit"))
    return ranking.rank_statistics(e, list(range(1000, 10001, 1000)))


def _repairs(spark, sf):
    return trials(spark, sf).select("sample", "length", F.least("dist", F.lit(3)).alias("edits"))


def density_by_length(spark, sf):
    d = ranking.densities(_repairs(spark, sf), 100).groupBy(F.floor(F.col("length") / 10).alias("tens"), "radius")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.log10(F.avg("density")), 6).alias("log_mean"), F.round(F.avg("at_radius"), 6).alias("admits"), F.round(F.var_pop("at_radius"), 6).alias("var"))


def outcome_counters(spark, sf):
    return ranking.counters(trials(spark, sf), F.floor(F.col("length") / 10).alias("tens"), F.col("dist"))


def attempt_averages(spark, sf):
    return ranking.attempt_averages(trials(spark, sf), 10_000, "dist")


def timeouts_by_patch(spark, sf):
    """Trials beyond ten seconds by distance and tens of tokens, with their shares."""
    late = (F.col("ms") >= 10_000).cast("double")
    return trials(spark, sf).groupBy("dist", F.floor(F.col("length") / 10).alias("tens")).agg(F.count(F.lit(1)).alias("n"), F.sum(late).cast("long").alias("late"), F.round(F.avg(late), 6).alias("share"))


def running_error(spark, sf):
    """Running mean of the absolute difference of predicted and true distance over the events of a type."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.abs(F.col("user_id") % 7 - F.col("event_id") % 5).alias("error"))
    return ranking.running_mean(e, "event_type", "event_id", F.col("error"), F.floor(F.col("event_id") / 4096)).select("event_id", "event_type", "mean")


def precision_rollup(spark, sf):
    """Shares of trials that are valid, right and right at once, with their time, by patch size, by model and size, and over all."""
    t = trials(spark, sf).rollup("model", "dist")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.agg(F.grouping_id().cast("long").alias("level"), share(~F.col("failed")).alias("valid"), share(F.col("rank0") >= 0).alias("right"), share(F.col("rank0") == 0).alias("first"), share(F.col("ms")).alias("ms"))


def model_validity(spark, sf):
    return trials(spark, sf).groupBy("model").agg(F.sum((~F.col("failed")).cast("long")).alias("valid"), F.count(F.lit(1)).alias("total"))


def score_table(spark, sf):
    """All ranks of each model and task, as counts by rank."""
    return ranking.score_histogram(trials(spark, sf), "rank0", "model", "task").select("model", "task", F.concat_ws(",", F.transform(F.map_entries("scores"), lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("scores"))


def edit_blankets(spark, sf):
    e = trials(spark, sf).where("rank0 >= 0").select("sample", "length", F.pmod("l_partkey", F.greatest("length", F.lit(1))).alias("pos"))
    size = e.groupBy("sample").agg(F.floor(F.max("length") / 10).alias("tens"))
    return ranking.blanket(e).join(size, "sample").groupBy("tens").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("positions"), 6).alias("positions"))


def multimask_accuracy(spark, sf):
    """Up to 200 words of each turn, by hash, guessed as the commonest successor of the word before; the same for the turn in lower case.

    Turns without a word to guess on either side give no row."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    counts = with_tokens(c, X.words(F.col("text"))).select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = {"ctx": F.substring_index("gram", " ", 1), "truth": F.substring_index("gram", " ", -1)}
    best = counts.withColumns(parts).groupBy("ctx").agg(F.max_by("truth", F.struct("n", F.col("truth"))).alias("guess"))
    # texts are shuffled, not their words: a text's first 200 are picked where it lies, and only repeated turns pick again
    c = c.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn")))
    sides = c.select("conv_id", "turn", "copies", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("text")), F.struct(F.lit("after").alias("side"), F.lower("text").alias("text")))).alias("x"))
    key = ["conv_id", "turn", "side"]
    grams = with_tokens(sides.select("conv_id", "turn", "copies", "x.*"), X.words(F.col("text")), *key, "copies")
    grams = with_tokens(grams, X.ngrams(F.col("w"), 2), *key, "copies")
    hashed = F.transform("w", lambda g, i: F.struct(F.md5(F.concat_ws("-", "conv_id", "turn", i)).alias("h"), i.alias("pos"), g.alias("gram")))
    first = F.when(F.size("w") <= 200, hashed).otherwise(F.slice(F.array_sort(hashed), 1, 200))
    once = grams.where("copies = 1").select(*key, F.explode(F.when(F.size("w") <= 200, F.col("w")).otherwise(F.transform(first, lambda g: g["gram"]))).alias("gram"))
    again = stats.take_per_group(grams.where("copies > 1").select(*key, F.inline(first)), key, 200, F.col("h"), F.col("pos")).select(*key, "gram")
    picked = once.unionByName(again).withColumns(parts).drop("gram")
    hit = picked.join(best, "ctx", "left").withColumn("hit", F.coalesce(F.col("guess") == F.col("truth"), F.lit(False)).cast("double"))
    side = lambda s: F.round(F.avg(F.when(F.col("side") == s, F.col("hit"))), 6).alias(s)
    return hit.groupBy("conv_id", "turn").agg(side("before"), side("after")).where("before is not null and after is not null")


def first_words_completed(spark, sf):
    """Whether one of the five commonest successors of a turn's first word begins its second: mean by role."""
    t = with_tokens(table(spark, sf, "conversations"), X.words(F.col("text")), "role").select("role", X.ngrams(F.col("w"), 2).alias("g"))
    counts = t.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumns({"ctx": F.substring_index("gram", " ", 1), "next": F.substring_index("gram", " ", -1)})
    top = stats.take_per_group(counts, ["ctx"], 5, F.desc("n"), F.asc("next")).groupBy("ctx").agg(F.collect_list("next").alias("top"))  # five each
    first = t.where(F.size("g") > 0).select("role", F.substring_index(F.get("g", F.lit(0)), " ", 1).alias("ctx"), F.substring_index(F.get("g", F.lit(0)), " ", -1).alias("truth"))
    return first.join(top, "ctx").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ranking.starts_the_truth(F.col("top"), F.col("truth"))), 6).alias("score"))


def largest_component(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ranking.argmax(F.col("embedding")).cast("long").alias("dim"))


def distance_agreement(spark, sf):
    """All pairs of benchmark items (a short list): edit distance over visible characters against distance of the vectors of their ids."""
    b = table(spark, sf, "benchmark").select("item_id", X.visible_chars(F.col("text")).alias("t")).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    other = b.select(F.col("item_id").alias("j"), F.col("t").alias("u"), F.col("embedding").alias("e"))
    pairs = b.join(other, F.col("item_id") < F.col("j"))
    pairs = pairs.select((F.levenshtein("t", "u") / F.greatest(F.length("t"), F.length("u"), F.lit(1))).alias("s"), X.euclid(F.col("embedding"), F.col("e")).alias("v"))
    return ranking.distance_agreement(pairs, "s", "v")


def character_distances(spark, sf):
    """How many characters, and one, apart each item and the next are."""
    b = table(spark, sf, "benchmark").select("item_id", X.visible_chars(F.col("text")).alias("t"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id")
    return both.groupBy((F.levenshtein("t", "u") + 1).cast("long").alias("chars")).agg(F.count(F.lit(1)).alias("n"))


def vector_shift(spark, sf):
    """Mean distance that a rewrite moves vectors, by label and rewrite; vectors that it leaves alone don't count."""
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rewrites = {"absolute": F.transform("v", lambda x: F.abs(x)), "clipped": F.transform("v", lambda x: F.least(x, F.lit(1.0))), "reversed": F.reverse("v")}
    each = e.select("label", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("sct"), r.alias("w")) for k, r in rewrites.items()])).alias("x")).select("label", "v", "x.*")
    return each.where("v <> w").groupBy("label", "sct").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.euclid(F.col("v"), F.col("w"))), 6).alias("shift"))


def side_by_side(spark, sf):
    """Lines and characters of each source before and after lines without letters go, as one JSON text."""
    d = table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("kept", F.col("line").rlike(r"\p{L}"))
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("a"), F.sum(F.length("line")).alias("b"), F.sum(F.col("kept").cast("long")).alias("c"), F.sum(F.when(F.col("kept"), F.length("line")).otherwise(0)).alias("d"))
    return s.select("source", F.to_json(F.struct(F.array("a", "b").alias("before"), F.array("c", "d").alias("after"))).alias("json"))


_T = """t AS (SELECT l_orderkey AS sample, CAST(l_quantity AS BIGINT) AS length, CAST(l_linenumber AS BIGINT) AS dist, CASE WHEN l_suppkey % 5 = 0 THEN -1 ELSE l_partkey % 40 END AS rank0,
  (l_partkey * 37 + l_suppkey * 101) % 12000 AS ms, l_returnflag AS model, l_linestatus AS task, l_suppkey % 11 = 0 AS failed, l_partkey, l_suppkey FROM lineitem)"""
_SUM = "CAST(coalesce(sum(CASE WHEN %s THEN 1 ELSE 0 END), 0) AS BIGINT)"
_VIS = "regexp_replace(text, '[^!-~]', '', 'g')"
QUERIES = {f.__name__: f for f in (
    precision_by_length_distance, precision_by_time, timed_rank_statistics, density_by_length, outcome_counters, attempt_averages, timeouts_by_patch, running_error, precision_rollup, model_validity, score_table,
    edit_blankets, multimask_accuracy, first_words_completed, largest_component, distance_agreement, character_distances, vector_shift, side_by_side)}
ORACLE_SQL = {
    "precision_by_length_distance": f"""WITH {_T}, c AS (SELECT length // 10 AS tens, dist, {_SUM % 'rank0 >= 0 AND rank0 < 20'} AS pos, {_SUM % 'rank0 >= 20'} AS high, {_SUM % 'rank0 < 0'} AS neg FROM t GROUP BY 1, 2)
        SELECT *, round(pos / (pos + high + neg + 1), 6) AS precision FROM c""",
    "precision_by_time": f"""WITH {_T}, g AS (SELECT k, CAST(cut AS BIGINT) AS cut FROM (VALUES (1::BIGINT), (5), (10), ({ranking.EVERY})) x(k), range(1000, 9001, 1000) y(cut)), d AS (SELECT * FROM t WHERE dist = 2)
        SELECT k, cut, (SELECT count(*) FROM d WHERE ms < cut AND rank0 >= 0 AND rank0 < k) AS hits, round((SELECT count(*) FROM d WHERE ms < cut AND rank0 >= 0 AND rank0 < k) / (SELECT count(*) FROM d), 6) AS precision FROM g""",
    "timed_rank_statistics": f"""WITH p AS (SELECT user_id AS sample, event_id AS place, event_id * 7919 % 10000 AS ms, event_type = 'purchase' AS hit FROM events),
        l AS (SELECT p.*, CAST(limit_ms AS BIGINT) AS limit_ms FROM p, range(1000, 10001, 1000) x(limit_ms) WHERE ms <= limit_ms),
        n AS (SELECT *, row_number() OVER (PARTITION BY sample, limit_ms ORDER BY place) AS nth FROM l),
        e AS (SELECT sample, limit_ms, coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN nth END), 0) AS rr, {_SUM % 'hit'} AS a, {_SUM % 'hit AND nth <= 1'} AS h1, {_SUM % 'hit AND nth <= 5'} AS h5, {_SUM % 'hit AND nth <= 10'} AS h10 FROM n GROUP BY 1, 2),
        s AS (SELECT count(DISTINCT sample) AS s FROM p)
        SELECT limit_ms, round(sum(rr) / any_value(s), 6) AS mrr, round(sum(h1) / any_value(s), 6) AS p_at_1, round(sum(h5) / any_value(s), 6) AS p_at_5, round(sum(h10) / any_value(s), 6) AS p_at_10, round(sum(a) / any_value(s), 6) AS p_at_all FROM e, s GROUP BY limit_ms""",
    "density_by_length": f"""WITH {_T}, r AS (SELECT sample, length, least(dist, 3) AS edits FROM t), x AS (SELECT *, max(edits) OVER (PARTITION BY sample) AS radius FROM r),
        g AS (SELECT sample, max(length) AS n, max(radius) AS k, count(*) AS admits, {_SUM % 'edits = radius'} AS at_radius FROM x GROUP BY sample),
        d AS (SELECT *, admits / list_sum(list_transform(range(1, k + 1), lambda c: list_product(list_transform(range(0, c), lambda i: (c * n + n + 1 - i) / (i + 1.0::DOUBLE))) * pow(101.0::DOUBLE, c))) AS density FROM g)
        SELECT n // 10 AS tens, k AS radius, count(*) AS n, round(log10(avg(density)), 6) AS log_mean, round(avg(at_radius), 6) AS admits, round(var_pop(at_radius), 6) AS var FROM d GROUP BY 1, 2""",
    "outcome_counters": f"WITH {_T} SELECT length // 10 AS tens, dist, {_SUM % 'rank0 = 0'} AS top1, {_SUM % 'rank0 >= 0'} AS recall, {_SUM % 'rank0 >= 0 AND NOT failed'} AS pos, count(*) AS total, {_SUM % 'failed'} AS errors FROM t GROUP BY 1, 2",
    "attempt_averages": f"""WITH {_T} SELECT dist, count(*) FILTER (WHERE rank0 >= 0 AND ms < 10000) AS succeeded, round(avg(ms) FILTER (WHERE rank0 >= 0 AND ms < 10000), 6) AS ms, round(avg(rank0) FILTER (WHERE rank0 >= 0 AND ms < 10000), 6) AS rank,
        round(avg(length * 1000.0::DOUBLE / (ms + 1)) FILTER (WHERE rank0 >= 0 AND ms < 10000), 6) AS throughput, count(*) FILTER (WHERE ms >= 10000) AS expired, round(avg(ms) FILTER (WHERE ms >= 10000), 6) AS expired_ms FROM t GROUP BY dist""",
    "timeouts_by_patch": f"WITH {_T} SELECT dist, length // 10 AS tens, count(*) AS n, count(*) FILTER (WHERE ms >= 10000) AS late, round(avg(CASE WHEN ms >= 10000 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM t GROUP BY 1, 2",
    "running_error": "SELECT event_id, event_type, round(avg(abs(user_id % 7 - event_id % 5)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
    "precision_rollup": f"""WITH {_T} SELECT model, dist, grouping_id(model, dist) AS level, round(avg(CAST(NOT failed AS DOUBLE)), 6) AS valid, round(avg(CAST(rank0 >= 0 AS DOUBLE)), 6) AS right,
        round(avg(CAST(rank0 = 0 AS DOUBLE)), 6) AS first, round(avg(CAST(ms AS DOUBLE)), 6) AS ms FROM t GROUP BY ROLLUP (model, dist)""",
    "model_validity": f"WITH {_T} SELECT model, {_SUM % 'NOT failed'} AS valid, count(*) AS total FROM t GROUP BY model",
    "score_table": f"WITH {_T}, n AS (SELECT model, task, rank0, count(*) AS n FROM t GROUP BY ALL) SELECT model, task, string_agg(rank0 || ':' || n, ',' ORDER BY rank0) AS scores FROM n GROUP BY model, task",
    "edit_blankets": f"""WITH {_T}, e AS (SELECT sample, length, l_partkey % greatest(length, 1) AS pos FROM t WHERE rank0 >= 0), s AS (SELECT sample, max(length) // 10 AS tens, count(DISTINCT pos) AS p FROM e GROUP BY sample)
        SELECT tens, count(*) AS n, round(avg(p), 6) AS positions FROM s GROUP BY tens""",
    "multimask_accuracy": r"""WITH c AS (SELECT conv_id, turn, 'before' AS side, text FROM conversations UNION ALL SELECT conv_id, turn, 'after', lower(text) FROM conversations),
        w AS (SELECT conv_id, turn, side, regexp_extract_all(text, '\w+') AS w FROM c), i AS (SELECT *, unnest(range(0, len(w) - 1)) AS pos FROM w WHERE len(w) > 1),
        g AS (SELECT conv_id, turn, side, pos, w[pos + 1] AS ctx, w[pos + 2] AS truth FROM i), n AS (SELECT ctx, truth, count(*) AS n FROM g WHERE side = 'before' GROUP BY ALL),
        b AS (SELECT ctx, truth AS guess FROM n QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, truth DESC) = 1),
        p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY md5(conv_id || '-' || turn || '-' || pos), pos) <= 200),
        h AS (SELECT p.*, CASE WHEN guess = truth THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM p LEFT JOIN b USING (ctx)),
        r AS (SELECT conv_id, turn, round(avg(hit) FILTER (WHERE side = 'before'), 6) AS before, round(avg(hit) FILTER (WHERE side = 'after'), 6) AS after FROM h GROUP BY ALL)
        SELECT * FROM r WHERE before IS NOT NULL AND after IS NOT NULL""",
    "first_words_completed": r"""WITH w AS (SELECT role, regexp_extract_all(text, '\w+') AS w FROM conversations), i AS (SELECT role, w, unnest(range(0, len(w) - 1)) AS pos FROM w WHERE len(w) > 1),
        n AS (SELECT w[pos + 1] AS ctx, w[pos + 2] AS nxt, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, nxt) <= 5),
        f AS (SELECT row_number() OVER () AS id, role, w[1] AS ctx, w[2] AS truth FROM w WHERE len(w) > 1), s AS (SELECT id, role, max(CASE WHEN starts_with(truth, nxt) THEN 1 ELSE 0 END) AS s FROM f JOIN t USING (ctx) GROUP BY ALL)
        SELECT role, count(*) AS n, round(avg(s), 6) AS score FROM s GROUP BY role""",
    "largest_component": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS dim FROM embeddings",
    "distance_agreement": f"""WITH b AS (SELECT item_id, {_VIS} AS t, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
        p AS (SELECT levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t), 1)::DOUBLE AS s, list_distance(a.e, b.e) AS v FROM b a JOIN b ON a.item_id < b.item_id)
        SELECT CAST(floor(s * 100) AS BIGINT) AS key, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM p GROUP BY 1""",
    "character_distances": f"WITH b AS (SELECT item_id, {_VIS} AS t FROM benchmark) SELECT CAST(levenshtein(a.t, b.t) + 1 AS BIGINT) AS chars, count(*) AS n FROM b a JOIN b ON b.item_id - 1 = a.item_id GROUP BY 1",
    "vector_shift": """WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        x AS (SELECT label, v, 'absolute' AS sct, list_transform(v, lambda x: abs(x)) AS w FROM e UNION ALL SELECT label, v, 'clipped', list_transform(v, lambda x: least(x, 1.0::DOUBLE)) FROM e UNION ALL SELECT label, v, 'reversed', list_reverse(v) FROM e)
        SELECT label, sct, count(*) AS n, round(avg(list_distance(v, w)), 6) AS shift FROM x WHERE v <> w GROUP BY ALL""",
    "side_by_side": r"""WITH d AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT *, regexp_matches(line, '\p{L}') AS kept FROM d)
        SELECT source, '{"before":[' || count(*) || ',' || CAST(sum(length(line)) AS BIGINT) || '],"after":[' || count(*) FILTER (WHERE kept) || ',' || CAST(coalesce(sum(length(line)) FILTER (WHERE kept), 0) AS BIGINT) || ']}' AS json FROM k GROUP BY source""",
}
