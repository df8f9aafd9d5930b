"""Broken and fixed pairs: preprocessing, seeded corruption, data sets, evaluation of candidate lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import distances, edit_distance, python_error
from ..functions.sequences import edits as aligned_edits
from ..functions.text import visible_chars
from . import edits, ranking


def preprocessed(
    pairs: DataFrame, valid: Callable[[Column], Column], tokens: Callable[[Column], Column], max_patch: int = 5, lengths: tuple[int, int] = (3, 80), max_lines: int = 4,
    vocabulary: list[str] | None = None, minimise: Callable[[Column, Column], Column] | None = None, accepts: Callable[[Column], Column] | None = None, take: int | None = None,
) -> DataFrame:
    """``pairs(broke, fixed)`` -> distinct (broke, fixed, b, f, n_edits), b and f being tokens.

    Kept: line counts at most max_lines apart; b of a fitting length, all in the vocabulary if there is one; broke invalid
    and fixed valid; after minimising the fix, if asked for, 1 to max_patch edits; f accepted by the grammar, if given;
    visible characters that differ.  ``take`` cuts the raw pairs first, by hash: the quick variant."""
    rows = pairs.select("broke", "fixed").where("broke is not null and fixed is not null").distinct()
    if take is not None:
        rows = rows.orderBy(F.md5(F.concat("broke", "fixed")), "broke", "fixed").limit(take)
    count = lambda t: F.size(F.split(t, "\n", -1))
    rows = rows.where(F.abs(count(F.col("broke")) - count(F.col("fixed"))) <= max_lines)
    rows = rows.where(visible_chars(F.col("broke")) != visible_chars(F.col("fixed")))
    rows = rows.where(~valid(F.col("broke")) & valid(F.col("fixed")))
    rows = rows.withColumns({"b": tokens(F.col("broke")), "f": tokens(F.col("fixed"))}).where(F.size("b").between(*lengths))
    if vocabulary is not None:
        known = F.array(*map(F.lit, vocabulary))
        rows = rows.where((F.size(F.array_except("b", known)) == 0) & (F.size(F.array_except("f", known)) == 0))
    if minimise is not None:
        rows = rows.withColumn("f", minimise(F.col("b"), F.col("f")))
    rows = rows.withColumn("n_edits", distances(F.col("b"), F.col("f"), max_patch)).where(F.col("n_edits").between(1, max_patch))
    return rows.where(accepts(F.col("f"))) if accepts is not None else rows


def parses_as_python(source: Column) -> Column:
    return python_error(source).isNull()


def with_all_edit_kinds(pairs: DataFrame, distance: int = 4) -> DataFrame:
    """``pairs(b, f)`` at that distance whose alignment inserts, deletes and substitutes."""
    e = pairs.withColumn("e", aligned_edits(F.col("b"), F.col("f")))
    return e.where((F.size("e") == distance) & (F.size(F.array_distinct(F.transform("e", lambda x: x["kind"]))) == 3)).drop("e")


def common_substitutions(table: DataFrame) -> DataFrame:
    """Edits (kind, old, new, n) -> substitutions of quoted tokens: (before, after, n), most frequent first."""
    quoted = lambda c: F.col(c).rlike(r"^['\"].+['\"]$")
    rows = table.where((F.col("kind") == "SUB") & quoted("old") & quoted("new"))
    return rows.groupBy(F.col("old").alias("before"), F.col("new").alias("after")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "before", "after")


def new_token_counts(table: DataFrame) -> DataFrame:
    """Edits (new, n) -> how often each token is put in, ε standing for none."""
    return table.groupBy(F.when(F.col("new") == "", "ε").otherwise(F.col("new")).alias("token")).agg(F.sum("n").alias("n"))


class Draws:
    """Numbers in [0, 1) from a hash of a seed and a counter: the same on every machine."""

    def __init__(self, *seed):
        self.seed, self.n = "-".join(map(str, seed)), 0

    def __call__(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.seed}-{self.n}".encode()).hexdigest()[:12], 16) / 2.0**48


#: Chance of at most one, two and three edits.
LENGTHS = (0.5, 0.8, 1.0)


def corrupted(word: Sequence[str], table: dict[tuple[str, str, str], list[tuple[str, str, int]]], draw: Draws, number: int | None = None) -> list[str]:
    """The word after 1 to 3 edits (or the given number).  An edit's place is drawn, then one of the table's (kind, new, weight)
    for its (left, old, right) by weight; a place that the table doesn't know loses, doubles or swaps its token."""
    out = list(word)
    u = draw()
    for _ in range(number or 1 + sum(u >= x for x in LENGTHS[:2])):
        if not out:
            break
        at = int(draw() * len(out))
        left, right = out[at - 1] if at else "BOS", out[at + 1] if at + 1 < len(out) else "EOS"
        able = table.get((left, out[at], right), [])
        pick = draw() * sum(n for *_, n in able)
        kind, new = ("DEL", "INS", "SUB")[int(draw() * 3)], out[int(draw() * len(out))]
        for k, t, n in able:
            if pick < n:
                kind, new = k, t
                break
            pick -= n
        out[at : at + 1] = [] if kind == "DEL" else [new] if kind == "SUB" else [out[at], new]
    return out


def corruptions(words: DataFrame, key: str, tokens: str, table: dict | None = None, per: int = 10, most_edits: int = 3, wanted: Callable[[list[str]], bool] | None = None, tries: int = 40, seed: int = 1) -> DataFrame:
    """(key, nth, broken): up to ``per`` distinct corruptions of each row, 1 to most_edits edits away, that are wanted.

    Tries are bounded by their number, not by a clock, so reruns agree; rows are independent."""
    kind = dict(words.dtypes)[key]

    def run(batches):
        for b in batches:
            keys, nths, out = [], [], []
            for k, w in zip(b.column(key).to_pylist(), b.column(tokens).to_pylist()):
                found: list[list[str]] = []
                for i in range(tries if w else 0):
                    if len(found) == per:
                        break
                    c = corrupted(w, table or {}, Draws(seed, k, i))
                    if c != w and c not in found and edit_distance(w, c, most_edits) is not None and (wanted is None or wanted(c)):
                        found.append(c)
                keys += [k] * len(found)
                nths += range(len(found))
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), pa.array(nths, pa.int32()), pa.array(out, pa.list_(pa.string()))], [key, "nth", "broken"])

    return words.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, nth int, broken array<string>")


def edit_table(counts: DataFrame, most: int = 10_000) -> dict[tuple[str, str, str], list[tuple[str, str, int]]]:
    """The ``most`` commonest context edits (kind, left, old, right, new, n) as ``corrupted`` wants them, reversed: what a fix puts in, a corruption takes out."""
    out: dict[tuple[str, str, str], list[tuple[str, str, int]]] = {}
    back = {"INS": "DEL", "SUB": "SUB"}
    for r in counts.where("kind <> 'DEL'").orderBy(F.desc("n"), "kind", "left", "old", "right", "new").limit(most).collect():  # bounded
        out.setdefault((r["left"], r["new"], r["right"]), []).append((back[r["kind"]], r["old"], r["n"]))
    return out


def data_sets(pairs: DataFrame, encode: Callable[[Column], Column], tenth: int = 10) -> tuple[DataFrame, DataFrame]:
    """``pairs(id, b, f)`` -> (training, validation) of (id, line): both sides encoded; one pair in ``tenth``, by hash, validates.

    Pairs whose tokens can't be encoded are left out."""
    line = F.concat_ws("\t", encode(F.col("b")), encode(F.col("f")))
    rows = pairs.where(encode(F.col("b")).isNotNull() & encode(F.col("f")).isNotNull()).select("id", line.alias("line"))
    held = F.pmod(F.xxhash64("line"), F.lit(tenth)) == 0
    return rows.where(~held), rows.where(held)


def evaluated(truth: DataFrame, scored: DataFrame, n: int = 10) -> DataFrame:
    """``truth(id, w, truth)``, ``scored(id, candidate, edits, score)`` -> precision at n by tens of tokens and by edits needed."""
    ranks = edits.rank_of_truth(edits.ranked(scored), truth).join(truth.select("id", F.size("w").alias("length"), F.size(aligned_edits(F.col("w"), F.col("truth"))).alias("dist")), "id")
    return ranking.precision_by_bucket(ranks, n, [F.floor(F.col("length") / 10).alias("tens"), F.col("dist")])


def rejections(candidates: DataFrame, source: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(valid candidates, the commonest errors of the others with their counts)."""
    rows = candidates.withColumn("error", python_error(F.col(source)))
    return rows.where("error is null").drop("error"), rows.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(most)


def agreement(df: DataFrame, one: Column, two: Column) -> DataFrame:
    """How often two parsers agree: (one, two, n)."""
    return df.groupBy(one.alias("one"), two.alias("two")).agg(F.count(F.lit(1)).alias("n"))


def multiple_choice(items: DataFrame, distractors: DataFrame, key: str, truth: str, word: str) -> DataFrame:
    """(key, choices, answer): the truth among its distractors, in hash order; answer is its 0-based place."""
    every = items.select(key, F.col(truth).alias("c"), F.lit(True).alias("own")).unionByName(distractors.select(key, F.col(word).alias("c"), F.lit(False).alias("own")))
    every = every.groupBy(key, "c").agg(F.max("own").alias("own")).withColumn("h", F.md5(F.concat_ws("-", key, "c")))
    every = every.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("h", "c")) - 1)
    return every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("choices"), F.max(F.when(F.col("own"), F.col("place"))).alias("answer")).where("answer is not null")
