"""Join, set and aggregate queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relalg, stats
from ..sources.corpus import table


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def join_inner_equi(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_left_equi(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


def join_nest(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    out = relalg.nest_join(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")
    return out.select("c_custkey", F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda x: x.cast("string")), ",").alias("orders"))


def join_left_first(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    right = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return relalg.left_join_first(c.select("c_custkey"), right, "c_custkey", F.asc("o_orderdate"), F.asc("o_orderkey")).select("c_custkey", "o_orderkey")


def join_inner_first(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    right = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return relalg.inner_join_first(c.select("c_custkey"), right, "c_custkey", F.desc("o_totalprice"), F.asc("o_orderkey")).select("c_custkey", "o_orderkey", "o_totalprice")


def join_map_lookup(spark, sf):
    s, n, r = _t(spark, sf, "supplier", "nation", "region")
    named = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    return s.join(F.broadcast(named), "s_nationkey", "left").select("s_suppkey", "n_name", "r_name")  # 25 rows by the schema


def join_total_lookup(spark, sf):
    c, n = _t(spark, sf, "customer", "nation")
    return relalg.total_lookup(c, n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "n_name").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def join_theta_contains(spark, sf):
    p, n = _t(spark, sf, "part", "nation")
    bits = n.select("n_nationkey", F.concat(F.lit("#"), F.col("n_nationkey").cast("string")).alias("bit"))
    return p.join(F.broadcast(bits), F.contains("p_brand", F.col("bit"))).select("p_partkey", "n_nationkey")  # 25 rows


def join_semi_anti(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    has, hasnt = relalg.membership_split(c, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return has.select("c_custkey", F.lit("has").alias("side")).unionByName(hasnt.select("c_custkey", F.lit("hasnt").alias("side")))


def join_cross_factorial(spark, sf):
    n, r = _t(spark, sf, "nation", "region")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    return n.select("n_name").crossJoin(F.broadcast(r.select("r_name"))).crossJoin(F.broadcast(models))


def join_zip_positional(spark, sf):
    s, c = _t(spark, sf, "supplier", "customer")
    return relalg.zip_join(s.select("s_suppkey", "s_name"), c.select("c_custkey", "c_name"), "s_suppkey", "c_custkey")


def not_null_filters(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    j = c.join(o.where("o_totalprice > 100000"), c.c_custkey == o.o_custkey, "left")
    return relalg.not_null(j, "o_orderkey").select("c_custkey", "o_orderkey")


def set_operations(spark, sf):
    c, s = _t(spark, sf, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    parts = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


def full_outer_keys(spark, sf):
    o, l = _t(spark, sf, "orders", "lineitem")  # noqa: E741
    a = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("ordered"))
    b = l.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    return a.join(b, "day", "full_outer").select(F.col("day").cast("string").alias("day"), F.coalesce("ordered", F.lit(0)).alias("ordered"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


def grouping_sets_summary(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], [F.col("l_returnflag"), F.col("l_linestatus")]]
    return l.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


def rollup_total(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("large"))


def decimal_mean_var(spark, sf):
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.var_pop(x) / 1e6, 4).alias("var_m"))


#: Order priorities and the names of their columns.
PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def pivot_report(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").pivot("o_orderpriority", list(PRIORITIES)).agg(F.round(F.avg("o_totalprice"), 4)).select("o_orderstatus", *[F.col(k).alias(n) for k, n in PRIORITIES.items()])


def correlation_by_flag(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def running_accuracy(spark, sf):
    e = table(spark, sf, "events")
    out = stats.running_hits(e.select("event_id", "event_type", "value"), "event_type", "event_id", F.col("value") > 50)
    return out.select("event_id", "hits", "total")


def chunk1000_rebalance(spark, sf):
    e = table(spark, sf, "events").withColumn("chunk", F.floor(F.col("event_id") / 1000))
    order = [F.md5(F.col("event_id").cast("string")), F.col("event_id")]
    ranked = e.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "event_type").orderBy(*order)))
    least = e.groupBy("chunk", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("chunk").agg(F.min("n").alias("least"))
    return ranked.join(least, "chunk").where("nth <= least").select("event_id", "chunk", "event_type")


def json_transform(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def tumbling_pairs(spark, sf):
    from ..sources.corpus import tumbling

    out = tumbling(table(spark, sf, "events"), "event_id", "event_type", 4, ["a", "b", "c", "d"])
    return out.groupBy("a", "b", "c", "d").agg(F.count(F.lit(1)).alias("n"))


def adjacent_gaps(spark, sf):
    e = table(spark, sf, "events").withColumn("next", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.where("next is not null").groupBy((F.col("next") - F.col("event_id")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


def topk_per_group(spark, sf):
    return stats.take_per_group(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey"))


def prev_this_next(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role", 1, "").over(w).alias("before"), F.lead("role", 1, "").over(w).alias("after"))
    return c.groupBy("before", "role", "after").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    join_inner_equi, join_left_equi, join_nest, join_left_first, join_inner_first, join_map_lookup, join_total_lookup, join_theta_contains, join_semi_anti,
    join_cross_factorial, join_zip_positional, not_null_filters, set_operations, full_outer_keys, grouping_sets_summary, rollup_total, decimal_mean_var, pivot_report,
    correlation_by_flag, running_accuracy, chunk1000_rebalance, json_transform, tumbling_pairs, adjacent_gaps, topk_per_group, prev_this_next)}
_CO = "customer JOIN orders ON c_custkey = o_custkey"
ORACLE_SQL = {
    "join_inner_equi": f"SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {_CO} GROUP BY c_nationkey",
    "join_left_equi": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_nest": "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_left_first": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey",
    "join_inner_first": "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON c_custkey = o_custkey",
    "join_map_lookup": "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "join_total_lookup": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_theta_contains": "SELECT p_partkey, n_nationkey FROM part JOIN nation ON contains(p_brand, '#' || CAST(n_nationkey AS VARCHAR))",
    "join_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has' ELSE 'hasnt' END AS side FROM customer",
    "join_cross_factorial": "SELECT n_name, r_name, model FROM nation, region, (VALUES ('m1'), ('m2')) m(model)",
    "join_zip_positional": "SELECT s_suppkey, s_name, c_custkey, c_name FROM supplier JOIN customer ON s_suppkey = c_custkey",
    "not_null_filters": f"SELECT c_custkey, o_orderkey FROM {_CO} WHERE o_totalprice > 100000",
    "set_operations": "SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "full_outer_keys": "SELECT CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, coalesce(ordered, 0) AS ordered, coalesce(shipped, 0) AS shipped FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS ordered FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1) b ON a.day = b.day",
    "grouping_sets_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))",
    "rollup_total": "SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "decimal_mean_var": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice) / 1e6::DOUBLE, 4) AS var_m FROM orders GROUP BY o_orderpriority",
    "pivot_report": "SELECT o_orderstatus, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{k}'), 4) AS {n}" for k, n in PRIORITIES.items()) + " FROM orders GROUP BY o_orderstatus",
    "correlation_by_flag": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "running_accuracy": "SELECT event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits, count(*) OVER w AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "chunk1000_rebalance": "WITH e AS (SELECT *, event_id // 1000 AS chunk FROM events), n AS (SELECT chunk, min(n) AS least FROM (SELECT chunk, event_type, count(*) AS n FROM e GROUP BY ALL) GROUP BY chunk) SELECT event_id, chunk, event_type FROM (SELECT *, row_number() OVER (PARTITION BY chunk, event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS nth FROM e) JOIN n USING (chunk) WHERE nth <= least",
    "json_transform": "SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY k",
    "tumbling_pairs": "WITH r AS (SELECT event_id // 4 AS g, max(event_type) FILTER (WHERE event_id % 4 = 0) AS a, max(event_type) FILTER (WHERE event_id % 4 = 1) AS b, max(event_type) FILTER (WHERE event_id % 4 = 2) AS c, max(event_type) FILTER (WHERE event_id % 4 = 3) AS d FROM events GROUP BY 1 HAVING count(*) = 4) SELECT a, b, c, d, count(*) AS n FROM r GROUP BY ALL",
    "adjacent_gaps": "SELECT gap, count(*) AS n FROM (SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events) WHERE gap IS NOT NULL GROUP BY gap",
    "topk_per_group": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3",
    "prev_this_next": "SELECT before, role, after, count(*) AS n FROM (SELECT role, lag(role, 1, '') OVER w AS before, lead(role, 1, '') OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY ALL",
}
