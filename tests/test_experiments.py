"""Compositions on small literal inputs."""

import random

import duckdb
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.operators import experiments as E
from quillstone.operators.parsing import Bigrams
from quillstone.plans import scores, tokens
from quillstone.plans.evaluation import DIALOGUE
from quillstone.sources import corpus


def test_sample_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line {i}\n--\nother {i}") for i in range(20)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(15)], "vec_id long, embedding array<double>")
    one = E.sample_with_vectors(docs, vectors, str(tmp_path / "s"), 10).collect()
    two = E.sample_with_vectors(docs.limit(0), vectors, str(tmp_path / "s"), 10).collect()
    assert len(one) == 10 and sorted(one) == sorted(two) and all(r["embedding"] == [float(r["doc_id"])] for r in one)


def test_examples_and_trees(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.kt").write_text("val x = 1\nval y = 2\nfun f( {\nfun g() {}\n")
    (tmp_path / "r" / "b.py").write_text("x = 1\n")
    (tmp_path / "r" / "c.py").write_text("x = \n")
    found = corpus.files(spark, str(tmp_path / "r"))
    assert sorted(r["line"] for r in E.kotlin_examples(found).collect()) == ["fun g() {}", "val x = 1"]
    t = E.mined_trees(found).collect()
    assert len(t) == 1 and t[0]["uri"].endswith("b.py") and t[0]["label"] == len(t[0]["nodes"]) // 10


def test_corrupted_and_lexed(spark):
    codes = spark.createDataFrame([(i, [f"t{j}" for j in range(5)]) for i in range(30)] + [(99, [])], "id long, w array<string>")
    got = E.good_and_corrupted(codes, "id", "w", 10).collect()
    assert len(got) == 10 and all(r["broken"] != r["good"] for r in got)
    rows = spark.createDataFrame([("x = (1", "y = (2)"), ("x = (1", "z = (3)"), ("a", "b")], "broke string, fixed string")
    got = [tuple(r) for r in E.lexed_pairs(rows).collect()]
    assert len(got) == 1 and got[0][1] == "NAME = ( NUMBER ) NEWLINE"


def test_corrections(spark):
    words = spark.createDataFrame([(1, ["user", "assistant"] * 2), (2, ["system", "user", "assistant"])], "id long, w array<string>")
    got = E.corrected(words, "id", "w", DIALOGUE, Bigrams.learnt([["user", "assistant"] * 2] * 3)).collect()
    assert {r["id"] for r in got} == {1, 2} and all(r["edits"] >= 1 for r in got)
    sizes = spark.createDataFrame([(["user"],), (None,)], "w array<string>").select(E.language_sizes(F.col("w"), DIALOGUE)).collect()
    assert sizes[1][0] is None and (sizes[0][0]["length"], sizes[0][0]["distance"]) == (1, 1) and sizes[0][0]["size"] == len(DIALOGUE.repairs(["user"], 2))


def test_checked_samples(spark):
    s = spark.createDataFrame([("|!\"}",), ("|!!}",), ("|z}",)], "c string")
    got = {r["valid"]: (r["n"], r["tokens"]) for r in E.checked_samples(s, "c", ["a", "b"], lambda w: F.array_contains(w, "b")).collect()}
    assert got == {True: (1, 2), False: (2, 3)}


def test_documentation_is_written_anew():
    model = models.BigramModel(Bigrams.learnt([["f()", "does", "it"]]))
    lines = ["f()", "  // old words", "x", "// more"]
    assert E.documented(model, lines[:2])[1] == "  // does it" and E.documented(model, lines, True)[3] == "// more" and E.documented(model, []) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_ids_shuffles_documents_not_words(spark, tmp_path):
    rows = [(1, "a b A c"), (1, "a"), (2, None), (3, "..."), (None, "b b"), (4, " ".join(f"w{i:03}" for i in range(600)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = tokens.vocabulary_ids(spark, str(tmp_path))
    assert {r["doc_id"]: (r["n"], r["unknown"]) for r in df.collect()} == {1: (5, 0), None: (2, 0), 4: (600, 103)}
    assert "token" not in _plan(df)


def test_multimask_picks_where_the_text_lies(spark, tmp_path):
    """Long, short and repeated turns equal SQL; no window over words without repeated turns."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c", "Dd", "e"]) for _ in range(n))
    same = text(300)
    rows = [(1, 0, text(500)), (1, 1, text(40)), (2, 0, same), (2, 0, same), (3, 0, "one"), (4, 0, None), (5, 0, text(201))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = scores.multimask_accuracy(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(scores.ORACLE_SQL["multimask_accuracy"])
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
    assert "copies" in _plan(df)
