"""Lexers and their inverses, method slicing, point sets, readers of models and batches on literal rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import lexers as L
from quillstone.functions import sequences as S
from quillstone.functions import text as X
from quillstone.sources import corpus


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t"))).first()[0]


def test_coarse_tokens_and_back(spark):
    source = 'int foo = bar(1, "a b") + 2; // end'
    tokens = [t for t in one(spark, source, L.lexemes) if not t.isspace()]
    coarse = one(spark, source, lambda t: L.coarsened(L.lexemes(t)))
    assert coarse == ["int", "w", "=", "w", "(", "0", ",", '""', ")", "+", "0", ";", "//"]
    df = spark.createDataFrame([(coarse, tokens), (["w", "w", "w", "x"], tokens)], "c array<string>, t array<string>")
    got = [r[0] for r in df.select(L.uncoarsened(F.col("c"), F.col("t"))).collect()]
    assert got == [tokens, ["foo", "bar", "w", "x"]]


def test_methods(spark):
    text = "class A(x) {\n  public int f(int a) {\n    return g(a);\n  }\n\n  x = 1\n  void broken(\n  private int h() { return 1; }\n}\n"
    assert L.sliced_methods(text)[0] == "public int f(int a) {\n  return g(a);\n}"
    assert L.sliced_methods("") == [] and L.sliced_methods("public int a;\n") == []
    assert L.sliced_methods("fun f() { }\nnext line\n\nfun g() { }") == ["fun f() { }\nnext line", "fun g() { }"]
    assert one(spark, "a|b", lambda t: L.methods(t, lambda s: s.split("|"))) == ["a", "b"]
    assert one(spark, "a", lambda t: L.methods(t, lambda s: 1 / 0)) is None
    assert one(spark, text, lambda t: L.methods(t, L.sliced_methods)) == L.sliced_methods(text)


def test_python_kinds_and_rendering(spark):
    source = "def f(a):\n    if a:\n        return [1, 's']\n    # x\n\nb = f(2)\n"
    kinds = one(spark, source, lambda t: L.python_kinds(L.python_tokens(t)))
    assert kinds[:8] == ["def", "NAME", "(", "NAME", ")", ":", "NEWLINE", "INDENT"] and kinds.count("DEDENT") == 2
    made = one(spark, kinds, L.rendered_python, "array<string>")
    assert one(spark, made, lambda t: L.python_kinds(L.python_tokens(t))) == kinds and one(spark, made, S.python_error) is None
    assert one(spark, "a", L.with_newline) == "a\n" and one(spark, "a\n", L.with_newline) == "a\n"


def test_subword_rules(spark):
    assert one(spark, "a\x00b�\tc​d e", L.cleaned) == "ab cd e"
    assert one(spark, "x" * 201, lambda t: L.wordpieces(t, frozenset(["x", "##x"]))) == ["[UNK]"]
    assert len(one(spark, "x" * 200, lambda t: L.wordpieces(t, frozenset(["x", "##x"])))) == 200
    ids = one(spark, ["b", "zz", "a"], lambda t: L.vocabulary_ids(t, ["[UNK]", "a", "b"]), "array<string>")
    assert ids == [2, 0, 1] and one(spark, [2, 0, 9], lambda t: L.vocabulary_tokens(t, ["[UNK]", "a", "b"]), "array<int>") == ["b", "[UNK]", None]


@pytest.mark.parametrize("source, place", [("x = 1", None), ("x = )", 4), ("a\nb = (", 6), ("", None), ("é = $", 4)])
def test_error_places(spark, source, place):
    assert one(spark, source, S.python_error_place) == place


def test_earth_mover_equals_all_assignments():
    rnd = random.Random(3)
    for n in range(1, 6):
        a, b = ([[rnd.random(), rnd.random()] for _ in range(n)] for _ in range(2))
        best = min(sum(math.dist(p, b[j]) for p, j in zip(a, order)) for order in itertools.permutations(range(n))) / n
        assert S.earth_mover(a, b) == pytest.approx(best)
    assert S.earth_mover([[0.0]], [[0.0], [4.0]]) == pytest.approx(2.0) and math.isnan(S.earth_mover([], [[1.0]]))
    assert S.earth_mover([[0.0], [1.0]], [[1.0], [0.0]]) == pytest.approx(0.0)


def test_point_sets(spark):
    df = spark.createDataFrame([([[0.0], [10.0]], [[1.0], [12.0]]), ([], [[1.0]])], "a array<array<double>>, b array<array<double>>")
    got = [r[0] for r in df.select(S.point_set_distances(F.col("a"), F.col("b"))).collect()]
    assert (got[0]["least"], got[0]["mover"]) == (1.0, 1.5) and got[1] is None


def test_documentation_and_brackets(spark):
    lines = ["// doc", "code()", "", " * more", "* "]
    assert one(spark, lines, X.documentation, "array<string>") == ["// doc", " * more"]
    assert one(spark, lines, X.code_lines, "array<string>") == ["code()", "", "* "]
    assert one(spark, "f(g(x), y)", X.until_last_call) == "f(g(" and one(spark, "none", X.until_last_call) == "none"
    masked = one(spark, "f(g[x])", lambda t: X.brackets_replaced(t, F.lit("s"), 2, "#"))
    assert masked.count("#") == 2 and len(masked) == 7 and masked == one(spark, "f(g[x])", lambda t: X.brackets_replaced(t, F.lit("s"), 2, "#"))
    assert one(spark, "f(x)", lambda t: X.brackets_replaced(t, F.lit("s"), 9, "")) == "fx"
    words = F.create_map(F.lit("big"), F.array(F.lit("large"), F.lit("huge")))
    score = one(spark, ["a", "big", "cat", "a"], lambda t: X.rouge_recall_with_synonyms(t, F.array(F.lit("huge"), F.lit("a")), words), "array<string>")
    assert score == pytest.approx(2 / 3)


def test_models_splits_and_batches(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a, b, c, d, 3\na,b,c,x,1\nbad\n")
    model = corpus.ngram_model(spark, str(tmp_path / "m.csv"))
    both = {tuple(r["ngram"]): r["n"] for r in corpus.merged_models(model, model, spark.createDataFrame([(["q"], 5)], "ngram array<string>, n long")).collect()}
    assert both == {("a", "b", "c", "d"): 6, ("a", "b", "c", "x"): 2, ("q",): 5}
    corpus.write_split(spark.range(300), "id", str(tmp_path / "s"))
    train, valid = (spark.read.parquet(str(tmp_path / "s" / k)) for k in ("train", "valid"))
    assert train.count() + valid.count() == 300 and 10 < valid.count() < 60 and train.intersect(valid).count() == 0
    blocks = spark.createDataFrame([(f"q{i}", "t", ["a", "t", "b", "c"][: 1 + i % 4]) for i in range(200)], "first string, second string, rest array<string>")
    got = corpus.training_batches(blocks, 2, 3).collect()
    assert len(got) == 100 and all("t" not in r["negatives"] and len(r["negatives"]) == 2 for r in got)
    sizes = {}
    for r in got:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + 1
    assert max(sizes.values()) <= 3
    rec = spark.createDataFrame([("a b c", "a b"), ("a", "b"), ("a b c", "a b c d e f g")], "first string, second string")
    assert corpus.small_repairs(rec, (2, 5), F.lit(3), F.abs(F.size(F.split("first", " ")) - F.size(F.split("second", " ")))).count() == 1


def test_texts_by_scheme(spark, tmp_path):
    import zipfile

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1\n---\n  y\n")
    (tmp_path / "r" / "b.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(tmp_path / "r" / "z.zip", "w") as z:
        z.writestr("in/c.kt", "fun f() {}")
        z.writestr("in/d.class", "no")
    found = corpus.files(spark, str(tmp_path / "r"), archives=True)
    got = {r["uri"].rsplit("/", 1)[1]: r["text"] for r in corpus.texts(found).collect()}
    assert got == {"a.py": "x = 1\n---\n  y\n", "b.bin": None, "c.kt": "fun f() {}", "d.class": None}
    assert sorted((r["line_no"], r["line"]) for r in corpus.indexed_lines(found).collect()) == [(0, "fun f() {}"), (0, "x = 1"), (2, "y")]
    assert corpus.files(spark, str(tmp_path / "r"), ("py", "kt"), archives=True).count() == 2
    codes = spark.createDataFrame([("ab", "c")], "q string, d string").select(corpus.query_with_document(F.col("q"), F.col("d"), 6)).first()[0]
    assert codes == [97, 98, 124, 99, 0, 0]


def test_kotlin_lexemes_and_type_ids(spark):
    import token

    source = 'val `a b` = """x\n"y" """ + 1.5f // c\nloop@ for (i in 0..2) {}'
    got = one(spark, source, L.kotlin_lexemes)
    assert "".join(got) == source and [t for t in got if not t.isspace()][:6] == ["val", "`a b`", "=", '"""x\n"y" """', "+", "1.5f"] and "loop@" in got
    assert one(spark, "x = 1", lambda t: L.python_type_ids(L.python_tokens(t)))[:3] == [token.NAME, token.OP, token.NUMBER]


def test_reports(spark):
    from quillstone.operators import reports

    df = spark.createDataFrame([("a_b", 0.5, None), ("c&d", 1.0, 2)], "model string, s double, n int")
    lines = reports.latex_table(df.orderBy("model")).split("\n")
    assert lines[0] == r"\begin{tabular}{lrr}" and lines[3] == r"a\_b & 0.500 & -- \\" and lines[4] == r"c\&d & 1.000 & 2 \\"
    scores = spark.createDataFrame([("m", 1), ("m", 1), ("m", 2)], "model string, s int")
    assert [r["json"] for r in reports.distributions_json(scores, "s", "model").collect()] == ['{"1":2,"2":1}']
