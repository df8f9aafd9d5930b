"""Validity predicates, functions by name, the model surface."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import models as M
from quillstone.functions import registry, validity
from quillstone.operators.parsing import Bigrams


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t"))).first()[0]


@pytest.mark.parametrize("make, value, want", [
    (validity.python_source, "x = 1", True), (validity.python_source, "x =", False), (validity.python_first_error, "x = 1", -1), (validity.python_first_error, "x = )", 4),
    (validity.python_message, "x = 1", ""), (lambda c: F.substring_index(validity.python_message(c), ":", 1), "x =", "SyntaxError"),
    (validity.balanced, "f(a[1], \"(\") { } // )", True), (validity.balanced, "f(]", False), (validity.balanced, ")", False), (validity.balanced, "(", False),
    (validity.java_like, "int a = b(1);", True), (validity.java_like, 'x = "a', False), (lambda c: validity.java_like(c, True), "int a = 1\nb();", False),
    (lambda c: validity.java_like(c, True), "@A\nint a = 1; // c\nif (x)\n  b();\n}\n{", False), (lambda c: validity.java_like(c, True), "if (x) {\n  b();\n}", True),
])
def test_predicates(spark, make, value, want):
    assert one(spark, value, make) == want


def test_token_predicates(spark):
    assert one(spark, ["x", "=", "1", "NEWLINE", "y"], validity.python_tokens, "array<string>") and not one(spark, ["x", "="], validity.python_tokens, "array<string>")
    import token

    good = [token.NAME, token.EQUAL, token.NUMBER, token.NEWLINE]
    assert one(spark, good, validity.python_numbers, "array<int>") and not one(spark, good[:2], validity.python_numbers, "array<int>")
    df = spark.createDataFrame([("f(1);",), ("f(1;",)], "s string")
    assert [r["s"] for r in validity.filter_valid(df, "s").collect()] == ["f(1);"] and validity.filter_valid(df, "s", "python").count() == 1


def test_functions_by_name(spark):
    df = spark.createDataFrame([("a + B",), ("c",)], "t string")
    got = sorted((r["t"], r["sct"], r["variant"]) for r in registry.rewritten(df, "t", ["same", "lower", "swap_plus_minus"]).collect())
    assert got == [("a + B", "lower", "a + b"), ("a + B", "swap_plus_minus", "a - B")]
    for name, metric in registry.STRING_METRICS.items():
        assert df.select(metric(F.col("t"), F.col("t"))).first()[0] == 0, name
    assert all(df.select(t(F.col("t")).alias("x")).first()["x"] for t in registry.TOKENIZERS.values())
    assert all(isinstance(df.select(p(F.col("t"))).first()[0], bool) for p in registry.PREDICATES.values())
    assert registry.register(spark) == ["split_methods"]
    spark.createDataFrame([("x\nfun f() { }\n\nfun g() {\n}",)], "s string").createOrReplaceTempView("sources")
    got = spark.sql("SELECT method, line FROM sources, LATERAL split_methods(s)").collect()
    assert sorted(map(tuple, got)) == [("fun f() { }", 1), ("fun g() {\n}", 3)]


def test_models(spark):
    model = M.BigramModel(Bigrams.learnt([list("abc"), list("abd"), list("abc")]))
    assert [t for t, _ in model.next_tokens(["a"], 1)] == ["b"] and M.completed(model, ["a"]) == ["b", "c"] and M.completed(model, [], most=1) == ["a"]
    assert M.filled(model, ["a", "_", "d"]) == ["a", "b", "d"] and M.filled(model, ["x"]) == ["x"]
    df = spark.createDataFrame([(1, ["a"], "old"), (2, None, "old"), (3, ["a"], "old")], "id long, w array<string>, answer string")
    got = {r["id"]: r["answer"] for r in M.ask(df, lambda: model, "w", M.completed).collect()}
    assert got == {1: ["b", "c"], 2: None, 3: ["b", "c"]}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert M.retried(flaky, wait=0) == "ok"
    with pytest.raises(ConnectionError):
        M.retried(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 0)
