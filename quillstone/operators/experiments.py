"""Compositions that experiments start from: samples with vectors, examples, trees, corrupted pairs, correction loops."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coding, lexers, trees, validity
from ..functions.models import TextModel, completed
from ..functions.text import COMMENT_PREFIXES
from ..sources.corpus import fragments, shuffled, texts
from . import pairs
from .automata import Grammar
from .parsing import Bigrams, scored_repairs


def sample_with_vectors(docs: DataFrame, vectors: DataFrame, path: str, n: int = 1000, seed: int = 1) -> DataFrame:
    """(doc_id, line_no, line, embedding): n fragments in the order of a seeded shuffle with their documents' vectors, written
    once to the path and read from there afterwards."""
    spark = docs.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        lines = fragments(docs, "text", "doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
        shuffled(lines, F.concat_ws("-", "doc_id", "line_no"), seed).limit(n).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kotlin_examples(found: DataFrame) -> DataFrame:
    """``files`` -> (line, coarse): distinct coarse shapes of the Kotlin files' valid lines, one line of each."""
    lines = fragments(texts(found, ("kt",)).where("text is not null"), "text", "uri").where(validity.java_like(F.col("line")))
    return lines.select("line", F.array_join(lexers.coarsened(lexers.lexemes(F.col("line"))), " ").alias("coarse")).groupBy("coarse").agg(F.min("line").alias("line"))


def mined_trees(found: DataFrame) -> DataFrame:
    """``files`` -> (uri, nodes, label): syntax trees of the Python files, labelled by tens of nodes; what doesn't parse goes."""
    t = texts(found, ("py",)).where("text is not null").select("uri", trees.tree_nodes(F.col("text")).alias("nodes")).where("nodes is not null")
    return t.withColumn("label", F.floor(F.size("nodes") / 10))


def good_and_corrupted(codes: DataFrame, key: str, tokens: str, n: int = 100_000) -> DataFrame:
    """(key, broken, good): one corruption of each of the n first codes in hash order."""
    first = codes.select(key, tokens).where(F.size(tokens) > 0).orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    return pairs.corruptions(first, key, tokens, per=1).drop("nth").join(first.withColumnRenamed(tokens, "good"), key)


def lexed_pairs(rows: DataFrame) -> DataFrame:
    """``rows(broke, fixed)`` -> both sides as kinds of Python tokens, space-joined; distinct, and only where they differ."""
    kinds = lambda c: F.array_join(lexers.python_kinds(lexers.python_tokens(F.col(c))), " ")
    return rows.select(kinds("broke").alias("broke"), kinds("fixed").alias("fixed")).where("broke <> fixed").distinct()


def corrected(words: DataFrame, key: str, tokens: str, grammar: Grammar, model: Bigrams, seed: int = 1) -> DataFrame:
    """(key, edits, restored): each row corrupted so that it leaves the language, repaired, and whether the best repair is the row."""
    broken = pairs.corruptions(words, key, tokens, per=1, wanted=lambda w: grammar.distance(w) != 0, seed=seed)
    best = broken.select(key, F.explode(F.array(F.get(scored_repairs(F.col("broken"), grammar, model, most=1), F.lit(0)))).alias("r"))
    return best.join(words.select(key, F.col(tokens).alias("_w")), key).select(key, F.col("r.edits").alias("edits"), (F.col("r.words") == F.col("_w")).alias("restored"))


def checked_samples(samples: DataFrame, code: str, alphabet: list[str], valid) -> DataFrame:
    """Decoded samples by whether they are valid: (valid, n, tokens); codes outside the alphabet are invalid."""
    s = samples.select(coding.uncharified(F.col(code), alphabet).alias("w"))
    fine = ~F.exists("w", lambda t: t.isNull()) & valid(F.col("w"))
    return s.groupBy(F.coalesce(fine, F.lit(False)).alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("tokens"))


def language_sizes(tokens: Column, grammar: Grammar, margin: int = 1) -> Column:
    """struct(length, distance, margin, size): how many words of the grammar lie within the distance plus the margin; null for null."""
    kind = pa.struct([("length", pa.int32()), ("distance", pa.int32()), ("margin", pa.int32()), ("size", pa.int64())])

    def run(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            d = None if t is None else grammar.distance(t)
            out.append(None if t is None else {"length": len(t), "distance": d, "margin": margin, "size": 0 if d is None else len(grammar.repairs(t, d + margin))})
        return pa.array(out, kind)

    return F.arrow_udf(run, "struct<length:int,distance:int,margin:int,size:long>")(tokens)


def documented(model: TextModel, lines: list[str], first_only: bool = False, most: int = 12) -> list[str]:
    """Comment lines (all, or the first) written anew by the model from the words before them."""
    out, done = [], False
    for line in lines:
        mark = line.strip()[:2]
        if mark in COMMENT_PREFIXES and len(line.strip()) > 1 and not (first_only and done):
            said = completed(model, " ".join(out).split(), most)
            out.append(f"{line[: len(line) - len(line.lstrip())]}{mark} {' '.join(said)}".rstrip())
            done = True
        else:
            out.append(line)
    return out
