"""Token codes, error messages, synonyms on literal rows."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import coding as C


@pytest.mark.parametrize("make, value, want", [
    (C.error_type, "Traceback\n  File x\nSyntaxError: bad: very\n", "SyntaxError"),
    (C.error_message, "Traceback\nSyntaxError: bad: very", "bad: very"),
    (C.error_message, "no colon", ""),
    (lambda c: C.tagged(c, "repair"), "x<repair>a\nb</repair><repair></repair>", ["a\nb", ""]),
    (C.python_token_id, "NAME", 1),
    (C.python_token_id, "NOTHING", -1),
    (lambda c: C.python_token_name(F.lit(1), True), "", "'NAME'"),
    (C.line_tokens, "fooBar HTTPServer x1_y", ["foo", "bar", "httpserver"[:5], "erver", "x", "1", "_", "y"]),
    (C.normalized_line, "a \t", "a"),
    (C.whitespace_tokens, "a  b", ["a", "", "b"]),
    (C.control_count, "a\x00\t​", 2),
    (C.punctuation_count, "a!$«»_", 5),
    (lambda c: C.padded(F.split(c, "").cast("array<int>"), 4), "12", [1, 2, 0, 0]),
    (lambda c: C.drop_sentinels(F.split(c, " ")), "BOS x EOS", ["x"]),
    (lambda c: C.drop_sentinels(F.split(c, " ")), "BOS EOS", []),
    (lambda c: C.synonymized(F.split(c, " "), F.create_map(F.lit("big"), F.lit("large"))), "a big one", ["a", "large", "one"]),
])
def test_functions(spark, make, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).first()[0] == want


def test_codes_round_trip(spark):
    alphabet = [r["token"] for r in C.token_numbers(spark.createDataFrame([("b",), ("a",), ("|x",), ("a",), (None,)], "token string")).orderBy("id").collect()]
    assert alphabet == ["a", "b", "|x"]
    df = spark.createDataFrame([(["a", "|x", "b"],), ([],), (["zzz"],)], "w array<string>").select("w", C.charified(F.col("w"), alphabet).alias("c"))
    got = [(r["w"], r["c"], r["back"]) for r in df.select("w", "c", C.uncharified(F.col("c"), alphabet).alias("back")).collect()]
    assert got == [(["a", "|x", "b"], "|!#\"}", ["a", "|x", "b"]), ([], "|}", []), (["zzz"], None, None)]


def test_synonyms(spark):
    words, table = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")], "word string, synonym string")
    got = {(r["synonym"], r["steps"]) for r in C.synonyms(words, table).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}
