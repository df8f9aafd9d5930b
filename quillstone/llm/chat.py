"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt.  The rest of each
conversation is a completion, with spans (start, length, trained) over its characters: the assistant's turns
are trained, all other text, turn headers included, is masked.

A conversation is one row of the result, so its turns meet in one row; nothing larger does.  DataFrame functions
only.  Edge cases: turns are ordered by (turn, role, text), repeated rows repeat the turn; a null text renders as
empty, a null role as an empty role, and two nulls are equal; rows of null pair id take no part; a pair that lacks
a side gives no row; equal conversations give two empty completions; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

TRAINED_ROLE = "assistant"
RING = 64


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column, start: Column) -> Column:
    """array<struct<start, length, trained>>: a masked header and a body for each turn, back to back from start."""
    part = lambda at, size, trained: F.struct(at.cast("int").alias("start"), size.alias("length"), trained.alias("trained"))
    return F.flatten(F.transform(turns, lambda t: F.array(
        part(t["before"] - start, F.length(_head(t)), F.lit(False)),
        part(t["before"] - start + F.length(_head(t)), F.length(_body(t)), F.coalesce(t["role"], F.lit("")) == TRAINED_ROLE))))


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    """One row a pair: its turns in order, each with the rendered length of those before it (a running sum, linear in the turns)."""
    turn = F.struct("role", "text")
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(_head(turn)) + F.length(_body(turn))
    rows = turns.where("pair_id is not null").withColumns({"nth": F.count(F.lit(1)).over(order), "before": F.sum(size).over(order) - size})
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "before"))).alias(name))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Two tables (pair_id, turn, role, text) -> (pair_id, n_prefix, prompt, chosen, chosen_spans, rejected, rejected_spans)."""
    columns = ["pair_id", "turn", "role", "text"]
    pairs = _conversations(chosen.select(*columns), "c").join(_conversations(rejected.select(*columns), "r"), "pair_id")
    same = F.zip_with("c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, F.lit(False)).cast("int")
    pairs = pairs.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size("c")))
    rest = lambda c: F.slice(F.col(c), F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    start = lambda c: F.coalesce(F.get(F.col(c), F.col("n_prefix"))["before"], F.lit(0))
    sides = F.struct(rest("c").alias("c"), start("c").alias("cs"), rest("r").alias("r"), start("r").alias("rs"))
    # behind a generator, so that the optimizer doesn't copy them into each turn's expression
    pairs = pairs.select("pair_id", "n_prefix", F.slice("c", 1, F.col("n_prefix")).alias("prefix"), F.explode(F.array(sides)).alias("x"))
    return pairs.select(
        "pair_id", "n_prefix", rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("x.c")).alias("chosen"), spans(F.col("x.c"), F.col("x.cs")).alias("chosen_spans"),
        rendered(F.col("x.r")).alias("rejected"), spans(F.col("x.r"), F.col("x.rs")).alias("rejected_spans"))


def last_answer_swapped(conversations: DataFrame) -> DataFrame:
    """Rejected conversations (pair_id, turn, role, text): the last assistant turn says what another conversation's last one says.

    Conversations with an assistant turn form rings by the hash of their ids, about ``RING`` in each, and take the
    answer of the next one in the ring.  One that is alone in its ring, or has no assistant turn, stays as it is."""
    last = conversations.where((F.col("role") == TRAINED_ROLE) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("last")).select("conv_id", F.col("last.turn").alias("at"), "last.text")
    last = checkpointed(last.withColumn("h", F.md5(F.col("conv_id").cast("string"))))
    n, width = last.count(), 0
    while n >= RING * 16 ** (width + 1):
        width += 1
    ring = Window.partitionBy(F.substring("h", 1, width)).orderBy("h", "conv_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alone = F.count(F.lit(1)).over(whole) == 1
    following = F.lead(F.struct("text")).over(ring)
    swap = last.select("conv_id", "at", F.coalesce(following, F.first(F.struct("text")).over(whole)).alias("swap"), alone.alias("alone"))
    mine = (F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("at")) & ~F.col("alone")
    return conversations.where("conv_id is not null").join(swap, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), "turn", "role", F.when(F.coalesce(mine, F.lit(False)), F.col("swap.text")).otherwise(F.col("text")).alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the formatted pairs (each conversation against itself with the last answer of another one)."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_preferences(conversations.withColumnRenamed("conv_id", "pair_id"), last_answer_swapped(conversations))
    trained = lambda c: F.aggregate(F.filter(c, lambda s: s["trained"]), F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
        F.md5("rejected").alias("rejected_md5"), trained("chosen_spans").alias("chosen_trained"), trained("rejected_spans").alias("rejected_trained"))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS l, md5(CAST(conv_id AS VARCHAR)) AS h FROM c WHERE role = 'assistant' GROUP BY conv_id),
wd AS (SELECT (SELECT count(*) FROM la) AS n),
wi AS (SELECT CASE WHEN n >= 64 * 65536 THEN 4 WHEN n >= 64 * 4096 THEN 3 WHEN n >= 64 * 256 THEN 2 WHEN n >= 64 * 16 THEN 1 ELSE 0 END AS w FROM wd),
rg AS (SELECT conv_id, l, h, substr(h, 1, w) AS k FROM la, wi),
nx AS (SELECT conv_id, l, lead({'t': l.text}) OVER (PARTITION BY k ORDER BY h, conv_id) AS f, first({'t': l.text}) OVER (PARTITION BY k ORDER BY h, conv_id) AS f0,
  count(*) OVER (PARTITION BY k) AS m FROM rg),
sw AS (SELECT conv_id, l.turn AS at_turn, coalesce(f, f0) AS swap, m FROM nx),
t AS (SELECT 0 AS side, c.* FROM c
  UNION ALL
  SELECT 1, c.conv_id, turn, role, CASE WHEN role = 'assistant' AND m > 1 AND turn IS NOT DISTINCT FROM at_turn THEN swap.t ELSE text END FROM c LEFT JOIN sw USING (conv_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
eq AS (SELECT conv_id, i, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AND a.side IS NOT NULL AND b.side IS NOT NULL AS same
  FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b USING (conv_id, i)),
pre AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS p FROM eq GROUP BY conv_id),
r AS (SELECT n.*, p, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS x,
    CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) + 8 ELSE 0 END AS trained FROM n JOIN pre USING (conv_id))
SELECT conv_id AS pair_id, CAST(any_value(p) AS BIGINT) AS n_prefix,
  md5(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= p), '')) AS prompt_md5,
  md5(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 0 AND i > p), '')) AS chosen_md5,
  md5(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE side = 1 AND i > p), '')) AS rejected_md5,
  CAST(coalesce(sum(trained) FILTER (WHERE side = 0 AND i > p), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(trained) FILTER (WHERE side = 1 AND i > p), 0) AS BIGINT) AS rejected_trained
FROM r GROUP BY conv_id
"""
