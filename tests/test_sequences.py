"""Distances, alignments and common substrings against plain code; readers and predicates on literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import sequences as S
from quillstone.functions import text as X
from quillstone.operators import pairs, vecindex
from quillstone.sources import corpus


def full(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return cost[-1][-1]


def test_distance_and_alignment():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        d = full(a, b)
        assert S.edit_distance(a, b) == d and S.edit_distance(a, b, d) == d and (d == 0 or S.edit_distance(a, b, d - 1) is None)
        edits = S.alignment(a, b)
        assert len(edits) == d
        out, at = [], 0
        for kind, pos, old, new in edits:
            out += a[at:pos]
            at = pos + (kind != "INS")
            assert kind == "INS" or a[pos] == old
            out += [new] if kind != "DEL" else []
        assert out + a[at:] == b
        codes = S.alignment_codes(a, b)
        assert len(codes) - codes.count("+") == len(a) and len(codes) - codes.count("-") == len(b)


def test_long_texts_with_few_edits_align_quickly():
    a = [str(i) for i in range(100_000)]
    b = a[:500] + ["x"] + a[500:70_000] + a[70_001:]
    assert [e[:2] for e in S.alignment(a, b)] == [("INS", 500), ("DEL", 70_000)]


def test_longest_common_substring():
    rnd = random.Random(2)
    for _ in range(300):
        group = ["".join(rnd.choice("ab_") for _ in range(rnd.randint(0, 10))) for _ in range(rnd.randint(1, 4))]
        parts = {s[i:j] for s in group for i in range(len(s)) for j in range(i + 1, len(s) + 1)} | {""}
        got = S.longest_common(group)
        assert all(got in s for s in group) and len(got) == max(len(p) for p in parts if all(p in s for s in group))
    assert S.longest_common(["abcd__xy", "abcd xy", "xy"]) == "xy" and S.longest_common([]) == "" and S.longest_common(["a", None]) == ""


def test_distances_are_the_numbers_of_edits_without_a_table(spark):
    rnd = random.Random(4)
    side = lambda: [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
    rows = [(i, side(), side()) for i in range(200)] + [(200, None, ["a"]), (201, ["a"] * 30, ["b"] * 30)]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").select("id", S.distances(F.col("a"), F.col("b"), 20).alias("d"), F.size(S.edits(F.col("a"), F.col("b"))).alias("n"))
    assert all(r["d"] == (r["n"] if r["n"] <= 20 else None) for r in df.collect())
    broke, fixed = " ".join(f"a{i}" for i in range(20)) + ",", " ".join(f"b{i}" for i in range(20))
    made = pairs.preprocessed(spark.createDataFrame([(broke, fixed)], "broke string, fixed string"), lambda t: ~F.contains(t, F.lit(",")), lambda t: F.split(t, " "), max_patch=1000)
    assert [r["n_edits"] for r in made.collect()] == [20]
    used = made._jdf.queryExecution().optimizedPlan().toString()
    assert "kind" not in used and "run(" in used  # no edits are made to be counted


def test_knn_edge_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [None, 1.0]), (8, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lambda **o: sorted((r["query_id"], r["rank"], r["vec_id"], r["dist"]) for r in vecindex.knn(df, df.where("vec_id < 6"), 2, block=2, **o).collect())
    assert got(keep_equal=True) == [(1, 1, 3, 0.0), (1, 2, 2, 5.0), (2, 1, 8, 0.0), (2, 2, 1, 5.0), (3, 1, 1, 0.0), (3, 2, 2, 5.0)]
    assert got() == [(1, 1, 2, 5.0), (1, 2, 8, 5.0), (2, 1, 1, 5.0), (2, 2, 3, 5.0), (3, 1, 2, 5.0), (3, 2, 8, 5.0)]


def test_nearest_and_furthest_equal_brute_force_in_bounded_pieces(spark, monkeypatch):
    """Copies tie by id at either end; null and short vectors have no distance; blocks return few rows."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 6)).round(1)
    x[50:150], x[300:330] = x[0] + 9.0, x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vecindex.nearest_and_furthest(df, df.where("vec_id % 100 = 0"), 7, 9, block=100).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["dist"]))
    assert sorted(got) == [0, 100, 200, 300, 1000] and all(d is None for _, d in got[1000])
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1)).round(9)
        others = [i for i in range(400) if i != q]
        mine = [(v, e) for v, e in got[q] if e is not None]
        assert [v for v, _ in sorted(mine, key=lambda t: (t[1], t[0]))][:7] == sorted(others, key=lambda i: (d[i], i))[:7]
        assert [v for v, _ in sorted(mine, key=lambda t: (-t[1], -t[0]))][:9] == sorted(others, key=lambda i: (-d[i], -i))[:9]
        assert len(got[q]) <= 16 * 40


def test_knn_of_copies_holds_few_pairs(spark, monkeypatch):
    """One vector with very many copies: ties by id, settled in pieces."""
    monkeypatch.setattr(vecindex, "PAIRS", 64)
    monkeypatch.setattr(vecindex, "SLAB", 32)
    x = np.random.default_rng(7).standard_normal((300, 5)).round(1)
    x[20:220] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vecindex.knn(df, df, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(12)
    for i in range(300):
        near = [j for j in sorted(range(300), key=lambda j: (d[i, j], j)) if (x[i] != x[j]).any()][:4]
        assert [got[i, k] for k in (1, 2, 3, 4)] == near


def test_knn_tells_apart_what_single_precision_does_not():
    """Near copies about a far point, with an outlier: exact ranks, and rough products stay within the stated error."""
    rng = np.random.default_rng(8)
    x = 1000.0 + 1e-6 * rng.standard_normal((500, 16))
    x[7] = -5e4
    z, w, slack = vecindex._halves(x, x[:50])
    scaled = x / 5e4
    true = (scaled[:50] - scaled.mean(axis=0)) @ (scaled - scaled.mean(axis=0)).T - ((scaled - scaled.mean(axis=0)) ** 2).sum(axis=1) / 2
    assert z.dtype == np.float32 and (np.abs(w @ z.T - true) <= slack[:, None]).all()
    q, v, d = vecindex._Nearest(x, np.arange(500), x[:50], np.arange(50), 5).search(False, z, w, slack)
    for i in range(50):
        want = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want[i] = np.inf
        assert v[q == i].tolist() == np.argsort(want)[:5].tolist()


def test_knn_equals_brute_force_and_index_reads_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vecindex.knn(df, df.where("vec_id % 10 = 0"), 5, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    near = lambda i: [int(j) for j in np.argsort(((x - x[i]) ** 2).sum(axis=1)) if j != i][:5]
    assert got == {i: near(i) for i in range(0, 300, 10)}
    index = vecindex.build_or_load(df, str(tmp_path / "v"), cells=8)
    again = vecindex.build_or_load(df.where("false"), str(tmp_path / "v"), cells=8)  # complete there: nothing is built
    for found in (index, again):
        all_cells = [r["vec_id"] for r in vecindex.knn_in_cells(found, x[7].tolist(), 6, probes=8).collect()]
        assert all_cells == [7, *near(7)]
    some = vecindex.knn_in_cells(index, x[7].tolist(), 6, probes=2)
    assert some.collect()[0]["vec_id"] == 7 and "cell" in some._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make, value, want", [
    (X.visible_length, "\x1b[31mred\x1b[0m!", 4),
    (X.without_cjk, "abc", True),
    (X.without_cjk, "漢字", False),
    (X.nontrivial_statement, "f(g(h(i(1))));", True),
    (X.nontrivial_statement, "f(g(1));", False),
    (X.nontrivial_statement, "f(g(h(i(1)))", False),
    (lambda c: X.matches_whole(c, "a|ab"), "ab", True),
    (lambda c: X.matches_whole(c, "a|ab"), "abc", False),
    (X.is_comment_or_empty, " // x", True),
    (X.is_comment_or_empty, "# x", False),
    (X.approx_cyclomatic, "if (a) { b[1]; } else return", 9),
    (X.license_class, "Copyright (c) MIT license", "MIT"),
    (X.license_class, "the Apache License", "Apache"),
    (lambda c: X.normal_form(X.camel_tokens(c), F.array_distinct(X.camel_tokens(c))), "fooBar fooBar", "012 01".replace(" ", "")),
    (lambda c: F.round(X.keyboard_distance(c, F.lit("L")), 4), ".", 19.3026),
    (lambda c: corpus.substring_range(c, 1, 3), "abcd", "bc"),
    (lambda c: corpus.substring_range(c, 2), "abcd", "cd"),
])
def test_scalar_functions(spark, make, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).first()[0] == want


def test_shuffled_is_a_permutation_by_seed(spark):
    df = spark.range(50)
    one, two = ([r["id"] for r in corpus.shuffled(df, F.col("id"), s).collect()] for s in (1, 2))
    assert sorted(one) == list(range(50)) and one != two and one == [r["id"] for r in corpus.shuffled(df.repartition(5), F.col("id"), 1).collect()]


def test_edit_contexts_and_training_log(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Type, Left, Old Mid, Right, New Mid, Frequency\nINS  , a , , b , c , 16\nSUB , a , x , b , UNKNOWN_CHAR , 2\n")
    got = corpus.edit_contexts(spark, str(tmp_path / "e.csv"), 0.5).collect()
    assert [(r["type"], r["old_mid"], r["new_mid"], r["freq"]) for r in got] == [("INS", "", "c", 4), ("SUB", "x", "UNKNOWN_CHAR", 1)]
    assert corpus.edit_contexts(spark, str(tmp_path / "e.csv"), drop_unknown=True).count() == 1
    log = [("a", 0, "step 10 | loss 2.5 | mrr 0.25"), ("a", 1, "  val@1 0.5"), ("b", 0, "step 20 | loss 1.5 | mrr 0.5"), ("b", 1, "other")]
    rows = corpus.training_log(spark.createDataFrame(log, "run string, line_no int, line string"), by="run").orderBy("run", "line_no").collect()
    assert [(r["step"], r["loss"], r["mrr"], r["val"]) for r in rows] == [(10, 2.5, 0.25, None), (10, None, None, 0.5), (20, 1.5, 0.5, None), (20, None, None, None)]
