"""Trees, distributions compared, splits and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences, text as X, trees
from ..operators import projection, stats
from ..sources.corpus import table


def statements(spark, sf):
    """Python statements made of the orders' columns, one of each shape, with the number of orders of the shape."""
    o = table(spark, sf, "orders").select(F.format_string(
        "def f_%s(key, *rest):\n    for i in range(%d):\n        total = price(key, [i, '%s']) + %s\n    return {'%s': total}\n",
        "o_orderstatus", F.col("o_custkey") % 3, "o_orderpriority", F.when(F.col("o_totalprice") > 200000, "rest[0]").otherwise("-1"), "o_orderstatus").alias("source"))
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def tree_edges(spark, sf):
    """Kinds of parent and child in the trees of all statements."""
    t = statements(spark, sf).select(F.col("n").alias("times"), F.explode(F.array(trees.tree_nodes(F.col("source")))).alias("t")).where("t is not null")
    e = t.select("times", "t", F.explode("t").alias("n")).where("n.parent >= 0").select("times", F.get("t", F.col("n.parent"))["kind"].alias("parent"), F.col("n.kind").alias("child"))
    return e.groupBy("parent", "child").agg(F.sum("times").alias("n"))


def tree_triples(spark, sf):
    """Kinds of a parent and two neighbouring children, which are neighbours in the node array too."""
    t = statements(spark, sf).select(F.col("n").alias("times"), F.explode(F.array(trees.tree_nodes(F.col("source")))).alias("t")).where("t is not null")
    pairs = t.select("times", "t", F.posexplode("t").alias("i", "a")).select("times", "t", "a", F.get("t", F.col("i") + 1).alias("b")).where("a.parent = b.parent")
    return pairs.groupBy(F.get("t", F.col("a.parent"))["kind"].alias("head"), F.col("a.kind").alias("left"), F.col("b.kind").alias("right")).agg(F.sum("times").alias("n"))


def python_errors(spark, sf):
    """Statements without each of their characters in turn, by the error of reading them; null: none."""
    s = statements(spark, sf).select("n", "source", F.explode(F.sequence(F.lit(1), F.length("source"))).alias("i"))
    cut = s.select("n", F.concat(F.substr("source", F.lit(1), F.col("i") - 1), F.substr("source", F.col("i") + 1)).alias("source"))
    return cut.groupBy(sequences.python_error(F.col("source")).alias("error")).agg(F.sum("n").alias("n"))


def shared_substring(spark, sf):
    """A substring common to all turns of a conversation."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.length(sequences.common_substring(F.transform("t", lambda x: x["text"]))).alias("chars"))


def length_emd(spark, sf):
    """Earth mover's distance, in tens of words, between each source's length distribution and that of all documents."""
    d = table(spark, sf, "documents").select("source", X.bucket10(F.size(X.words(F.col("text")))).alias("bucket"))
    n = d.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    buckets = n.groupBy("bucket").agg(F.sum("n").alias("all"))
    sources = n.groupBy("source").agg(F.sum("n").alias("size"))
    grid = sources.crossJoin(buckets).join(n, ["source", "bucket"], "left")  # aggregates: sources times length buckets
    run = Window.partitionBy("source").orderBy("bucket")
    own, every = F.sum(F.coalesce("n", F.lit(0))).over(run) / F.col("size"), F.sum("all").over(run) / F.sum("all").over(Window.partitionBy("source"))
    step = F.coalesce(F.lead("bucket").over(run) - F.col("bucket"), F.lit(0)) / 10
    return grid.select("source", (F.abs(own - every) * step).alias("d")).groupBy("source").agg(F.round(F.sum("d"), 6).alias("emd"))


def dimension_shift(spark, sf):
    """How far each label's mean lies from the mean of all, by dimension, as a share of the label's total shift."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    by_dim = Window.partitionBy("dim")
    shift = e.withColumn("shift", F.abs(F.col("s") / F.col("n") - F.sum("s").over(by_dim) / F.sum("n").over(by_dim)))
    return shift.select("label", "dim", F.round(F.col("shift") / F.sum("shift").over(Window.partitionBy("label")), 6).alias("share"))


def sorted_by_distance(spark, sf):
    """The 20 items whose visible characters are nearest to the first item's."""
    b = table(spark, sf, "benchmark").select("item_id", X.visible_chars(F.col("text")).alias("t"))
    first = b.where("item_id = 0").select(F.col("t").alias("q"))
    return b.crossJoin(F.broadcast(first)).select("item_id", F.levenshtein("t", "q").cast("long").alias("dist")).orderBy("dist", "item_id").limit(20)  # one row


def length_split(spark, sf):
    """Fifty documents of each length bucket go to validation, the rest to training: both sides by bucket."""
    d = table(spark, sf, "documents").select("doc_id", X.bucket10(F.size(X.words(F.col("text")))).alias("bucket"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    val = stats.take_per_group(d, ["bucket"], 50, F.col("h"), F.col("doc_id")).groupBy("bucket").agg(F.count(F.lit(1)).alias("val"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(val, "bucket").select("bucket", "val", (F.col("n") - F.col("val")).alias("train"))


def frequent_productions(spark, sf):
    """Bigrams of the benchmark that are doubled words or occur more than ten times."""
    w = table(spark, sf, "benchmark").select(F.explode(F.array(X.words(F.lower("text")))).alias("w"))
    n = w.select(F.explode(X.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") > 10) | (F.substring_index("gram", " ", 1) == F.substring_index("gram", " ", -1)))


#: Event types, a column each.
EVENTS = ["click", "error", "purchase", "signup", "view"]


def hits_by_bin(spark, sf):
    """Share of events over 50 by user decade, one column for each type."""
    e = table(spark, sf, "events").groupBy(X.bin10(F.col("user_id")).alias("bin")).pivot("event_type", EVENTS)
    return e.agg(F.round(F.avg((F.col("value") > 50).cast("double")), 6))


def vec_reduce_dim(spark, sf):
    """Two principal coordinates of every vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    head = e.select(F.size("embedding").alias("n")).first()
    if head is None:
        return spark.createDataFrame([], "vec_id long, x double, y double")
    p = projection.project(e, "vec_id", *projection.principal_axes(e, head["n"]))
    return p.select("vec_id", F.round(F.col("coordinates")[0], 6).alias("x"), F.round(F.col("coordinates")[1], 6).alias("y"))


_SIZE = r"len(regexp_extract_all(text, '\w+'))"
QUERIES = {f.__name__: f for f in (
    tree_edges, tree_triples, python_errors, shared_substring, length_emd, dimension_shift, sorted_by_distance, length_split, frequent_productions, hits_by_bin, vec_reduce_dim)}
ORACLE_SQL = {
    "length_emd": f"""WITH n AS (SELECT source, {_SIZE} // 10 * 10 AS bucket, count(*) AS n FROM documents GROUP BY ALL),
        g AS (SELECT s.source, size, b.bucket, a, coalesce(n, 0) AS n FROM (SELECT source, sum(n) AS size FROM n GROUP BY source) s CROSS JOIN (SELECT bucket, sum(n) AS a FROM n GROUP BY bucket) b
          LEFT JOIN n ON n.source = s.source AND n.bucket = b.bucket),
        d AS (SELECT source, abs(sum(n) OVER w / size - sum(a) OVER w / sum(a) OVER (PARTITION BY source)) * coalesce(lead(bucket) OVER w - bucket, 0) / 10 AS d FROM g WINDOW w AS (PARTITION BY source ORDER BY bucket))
        SELECT source, round(sum(d), 6) AS emd FROM d GROUP BY source""",
    "dimension_shift": """WITH e AS (SELECT label, dim, sum(CAST(x AS DOUBLE)) AS s, count(x) AS n FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY ALL),
        m AS (SELECT label, dim, abs(s / n - sum(s) OVER (PARTITION BY dim) / sum(n) OVER (PARTITION BY dim)) AS shift FROM e)
        SELECT label, CAST(dim AS INTEGER) AS dim, round(shift / sum(shift) OVER (PARTITION BY label), 6) AS share FROM m""",
    "sorted_by_distance": """WITH b AS (SELECT item_id, regexp_replace(text, '[^!-~]', '', 'g') AS t FROM benchmark)
        SELECT item_id, levenshtein(t, (SELECT t FROM b WHERE item_id = 0)) AS dist FROM b ORDER BY dist, item_id LIMIT 20""",
    "length_split": f"""WITH d AS (SELECT doc_id, {_SIZE} // 10 * 10 AS bucket FROM documents), r AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM d)
        SELECT bucket, count(*) FILTER (WHERE r <= 50) AS val, count(*) FILTER (WHERE r > 50) AS train FROM r GROUP BY bucket""",
    "frequent_productions": r"""WITH g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM benchmark))
        SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) > 10 OR split_part(gram, ' ', 1) = split_part(gram, ' ', 2)""",
    "hits_by_bin": "SELECT (user_id + 1) // 10 * 10 AS bin, " + ", ".join(f"round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in EVENTS) + " FROM events GROUP BY 1",
}
