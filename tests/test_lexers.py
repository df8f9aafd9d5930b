"""Lexers and subword tokenizers on small sources."""

from pyspark.sql import functions as F

from quillstone.functions import lexers as L
from quillstone.operators import markov


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_lexemes_are_the_text(spark):
    text = 'int x = 3.5; // "no"\nString s = "a\\"b" + \'c\'; /* many\n * lines */ if (x) { }'
    got = _one(spark, text, L.lexemes)
    assert "".join(got) == text and '"a\\"b"' in got and '// "no"' in got and "/* many\n * lines */" in got
    assert _one(spark, 'if (x > 10) return "a"; // b', lambda t: L.coarsened(L.lexemes(t))) == ["if", "(", "w", ">", "0", ")", "return", '""', ";", "//"]
    assert _one(spark, "", L.lexemes) == [] and _one(spark, None, L.lexemes) is None


def test_python_tokens(spark):
    got = _one(spark, "x = [1]\n", L.python_tokens)
    assert [(t.kind, t.text) for t in got][:5] == [("NAME", "x"), ("OP", "="), ("OP", "["), ("NUMBER", "1"), ("OP", "]")]
    assert _one(spark, "x = (", L.python_tokens)[-1].kind == "ERRORTOKEN"
    assert _one(spark, None, L.python_tokens) is None


def test_subwords(spark):
    assert _one(spark, "Don't stop-it 漢字", L.basic_tokens) == ["don", "'", "t", "stop", "-", "it", "漢", "字"]
    vocabulary = frozenset(["snow", "##b", "##ball", "##s", "ball"])
    assert _one(spark, "snowballs", lambda t: L.wordpieces(t, vocabulary)) == ["snow", "##ball", "##s"]
    assert _one(spark, "xyz", lambda t: L.wordpieces(t, vocabulary)) == ["[UNK]"]
    assert _one(spark, "", lambda t: L.wordpieces(t, vocabulary)) == []


def test_methods(spark):
    source = "class A {\n  public int f() {\n    if (x) { y(); }\n  }\n  private void g()\n  {\n  }\n  public int open() {\n"
    assert [m.split("(")[0].strip() for m in _one(spark, source, L.methods)] == ["public int f", "private void g"]


def test_walks(spark):
    chain = markov.transitions(spark.createDataFrame([("a", "b")] * 2 + [("b", "c")], "ctx string, next string"))
    starts = spark.createDataFrame([(1, "a"), (2, "z")], "walk long, ctx string")
    assert dict((r.walk, r.words) for r in markov.walks(chain, starts, 5).collect()) == {1: ["a", "b", "c"], 2: ["z"]}
