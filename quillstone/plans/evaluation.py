"""Ranking evaluation, masking, weighted sampling, automata and grammar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import automata, vecindex
from ..sources.corpus import table
from .search import _KNN, _KNN_ALL, knn_graph_edges

#: Balanced brackets of one kind, without the empty word.
DYCK = automata.Grammar("S", (("S", "S", "S"), ("S", "L", "R"), ("S", "L", "T"), ("T", "S", "R")), (("L", "("), ("R", ")")))
#: Dialogues: questions and answers in turn, perhaps after a system turn.
DIALOGUE = automata.Grammar("D", (("D", "D", "D2"), ("D", "Q", "A"), ("D", "S", "D2"), ("D2", "Q", "A")), (("Q", "user"), ("A", "assistant"), ("S", "system")))


def _near(spark, sf, k):
    """The k nearest of every hundredth vector, with both labels."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    return vecindex.knn(e, e.where("vec_id % 100 = 0"), k).join(labels, "vec_id").join(asked, "query_id")


def pak_grouping_sets(spark, sf):
    """Rank of the first neighbour of the same label: MRR and P@1 by label, by bucket, and by both."""
    first = F.coalesce(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank") - 1)), F.lit(-1))
    r = _near(spark, sf, 10).groupBy("query_id", "q_label").agg(first.alias("r")).withColumn("bucket", F.floor(F.col("query_id") / 100) % 3)
    return r.groupingSets([["q_label"], ["bucket"], ["q_label", "bucket"]], "q_label", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("r") >= 0, 1.0 / (F.col("r") + 1)).otherwise(0.0)), 6).alias("mrr"),
        F.round(F.avg((F.col("r") == 0).cast("double")), 6).alias("p_at_1"))


def precision_recall_at_k(spark, sf):
    """Precision and recall of the 10 nearest, relevant being the label's other vectors."""
    sizes = table(spark, sf, "embeddings").groupBy(F.col("label").alias("q_label")).agg((F.count(F.lit(1)) - 1).alias("relevant"))
    hits = _near(spark, sf, 10).groupBy("query_id", "q_label").agg(F.sum((F.col("label") == F.col("q_label")).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return hits.join(sizes, "q_label").select("query_id", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("precision"),
                                              F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 6).alias("recall"))


def nearest_other_label(spark, sf):
    """Smallest distance between every hundredth vector and its ten nearest, by pair of labels."""
    return _near(spark, sf, 10).groupBy("q_label", "label").agg(F.round(F.min("dist"), 6).alias("least"))


def knn_bfs(spark, sf):
    """Vectors within three steps of vector 0 in the undirected five-neighbour graph of all vectors."""
    return _within_three(knn_graph_edges(spark, sf))


def _within_three(edges):
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return vecindex.breadth_first(both, 0, 3).select("node", F.col("level").cast("long"))


def masked_tokens(spark, sf):
    """A fifth of each turn's tokens (1 to 20) picked by hash; of these 8 in 10 masked, 1 kept, 1 replaced by another of the turn."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    t = t.withColumn("hashes", F.transform("w", lambda _, i: F.md5(F.concat_ws("-", "conv_id", "turn", i))))
    t = t.withColumn("picked", F.slice(F.array_sort("hashes"), 1, F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.size("w") / 5).cast("int")))))

    def replaced(w, i):
        h = F.get("hashes", i)
        draw = F.conv(F.substring(h, 9, 4), 16, 10).cast("long")
        other = F.get("w", (F.conv(F.substring(h, 17, 4), 16, 10).cast("long") % F.size("w")).cast("int"))
        return F.when(~F.array_contains("picked", h), w).when(draw % 10 < 8, "[MASK]").when(draw % 10 == 8, w).otherwise(other)

    return t.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.size("picked").cast("long").alias("n_picked"),
                    F.md5(F.array_join(F.transform("w", replaced), " ")).alias("masked_md5"))


def weighted_sample(spark, sf):
    """100 orders without replacement, by total price: smallest exponential keys from a hash of the order."""
    u = (F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 12), 16, 10).cast("double") + 1.0) / F.lit(281474976710657.0)
    o = table(spark, sf, "orders").where("o_totalprice > 0").select("o_orderkey", (-F.log(u) / F.col("o_totalprice")).alias("key"))
    return o.orderBy("key", "o_orderkey").limit(100).select("o_orderkey")


def dfa_filter(spark, sf):
    """Parts of brands that the learnt automaton accepts: it learns the digits of brands with at least an average number of
    parts, against those of the others (1000 brands at most), and agrees with all that it learnt from."""
    p = table(spark, sf, "part")
    n = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    known = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).orderBy(F.desc("n"), "p_brand").limit(1000).collect()  # one row; 1000 brands
    words = lambda good: ["".join(c for c in r["p_brand"] or "" if c.isdigit()) for r in known if (r["n"] >= r["mean"]) == good]
    dfa = automata.learn_dfa(words(True), words(False))
    return p.where(automata.accepted(F.regexp_extract_all("p_brand", F.lit("([0-9])")), dfa)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def _roles(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return t.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"))


def dialogue_distance(spark, sf):
    """Edits that make each conversation's roles a dialogue, by number of conversations."""
    return _roles(spark, sf).groupBy(automata.grammar_distance(F.col("roles"), DIALOGUE).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def dialogue_repairs(spark, sf):
    """How many dialogues lie at the smallest distance from each conversation's roles."""
    return _roles(spark, sf).select("conv_id", F.size(automata.grammar_repairs(F.col("roles"), DIALOGUE)).alias("repairs"))


QUERIES = {f.__name__: f for f in (
    pak_grouping_sets, precision_recall_at_k, nearest_other_label, knn_bfs, masked_tokens, weighted_sample, dfa_filter, dialogue_distance, dialogue_repairs)}
_LABELLED = "l AS (SELECT k.*, a.label, b.label AS q_label FROM k JOIN embeddings a ON a.vec_id = k.vec_id JOIN embeddings b ON b.vec_id = k.query_id)"
ORACLE_SQL = {
    "pak_grouping_sets": f"""WITH {_KNN % 10}, {_LABELLED},
        r AS (SELECT query_id, q_label, coalesce(min(CASE WHEN label = q_label THEN rank - 1 END), -1) AS r, query_id // 100 % 3 AS bucket FROM l GROUP BY query_id, q_label)
        SELECT q_label, bucket, count(*) AS n, round(avg(CASE WHEN r >= 0 THEN 1.0::DOUBLE / (r + 1) ELSE 0.0 END), 6) AS mrr,
          round(avg(CASE WHEN r = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_at_1 FROM r GROUP BY GROUPING SETS ((q_label), (bucket), (q_label, bucket))""",
    "precision_recall_at_k": f"""WITH {_KNN % 10}, {_LABELLED}, s AS (SELECT label AS q_label, count(*) - 1 AS relevant FROM embeddings GROUP BY label),
        h AS (SELECT query_id, q_label, CAST(sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM l GROUP BY query_id, q_label)
        SELECT query_id, hits, round(hits / n, 6) AS precision, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0.0 END, 6) AS recall FROM h JOIN s USING (q_label)""",
    "nearest_other_label": f"WITH {_KNN % 10}, {_LABELLED} SELECT q_label, label, round(min(dist), 6) AS least FROM l GROUP BY q_label, label",
    "knn_bfs": f"""WITH RECURSIVE {_KNN_ALL % 5}, e AS (SELECT query_id AS u, vec_id AS v FROM k UNION SELECT vec_id, query_id FROM k),
        b AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS level UNION SELECT e.v, level + 1 FROM b JOIN e ON e.u = b.node WHERE level < 3)
        SELECT node, min(level) AS level FROM b GROUP BY node""",
    "masked_tokens": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\w+') AS w FROM conversations),
        x AS (SELECT *, len(w) AS n, unnest(range(len(w))) AS p FROM t WHERE len(w) > 0),
        h AS (SELECT *, md5(conv_id || '-' || turn || '-' || p) AS h FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY h) <= least(20, greatest(1, n // 5)) AS picked,
          CAST('0x' || substr(h, 9, 4) AS BIGINT) % 10 AS draw, CAST('0x' || substr(h, 17, 4) AS BIGINT) % n AS other FROM h)
        SELECT conv_id, turn, max(n) AS n, count(*) FILTER (WHERE picked) AS n_picked,
          md5(string_agg(CASE WHEN NOT picked THEN w[p + 1] WHEN draw < 8 THEN '[MASK]' WHEN draw = 8 THEN w[p + 1] ELSE w[other + 1] END, ' ' ORDER BY p)) AS masked_md5
        FROM r GROUP BY conv_id, turn""",
    "dfa_filter": "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM n WHERE n >= (SELECT avg(n) FROM n)",
    "weighted_sample": """SELECT o_orderkey FROM (SELECT o_orderkey, -ln((CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) + 1.0::DOUBLE) / 281474976710657.0::DOUBLE) / o_totalprice AS key
        FROM orders WHERE o_totalprice > 0) ORDER BY key, o_orderkey LIMIT 100""",
}
