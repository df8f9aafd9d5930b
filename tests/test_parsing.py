"""Weighted parsing, automata, hole filling, corruption and pair pipelines against plain enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions import trees
from quillstone.operators import automata, graphs, pairs, parsing

#: Sums without brackets: ambiguous.
SUMS = parsing.WeightedGrammar("E", (("E", "E", "R", 0.4), ("R", "P", "E", 1.0)), (("E", "x", 0.5), ("E", "y", 0.1), ("P", "+", 1.0)))


def derivations(g, head, word):
    """All (probability, tree) of a head by definition."""
    out = [(p, f"({h} {word[0]})") for h, t, p in g.tokens if h == head and list(word) == [t]]
    for h, a, b, p in g.pairs:
        if h == head:
            for k in range(1, len(word)):
                out += [(p * x * y, f"({h} {s} {t})") for x, s in derivations(g, a, word[:k]) for y, t in derivations(g, b, word[k:])]
    return out


@pytest.mark.parametrize("text", ["x", "x + y", "x + y + x", "x + x + y + x + y", "+", "x y", ""])
def test_inside_and_best_equal_enumeration(text):
    word = text.split()
    every = sorted(derivations(SUMS, "E", word), key=lambda d: (-d[0], d[1])) if word else []
    assert SUMS.probability(word) == pytest.approx(sum(p for p, _ in every))
    got = SUMS.best(word, 3)
    assert [p for p, _ in got] == pytest.approx([p for p, _ in every[:3]]) and {t for _, t in got} <= {t for _, t in every}
    used = SUMS.expected_counts(word)
    total = sum(p for p, _ in every)
    for rule in [("E", "x"), ("E", "y"), ("P", "+")] if total else []:
        assert used.get(rule, 0.0) == pytest.approx(sum(p * t.count(f"({rule[0]} {rule[1]})") for p, t in every) / total)
    assert not total or used.get(("R", "P", "E"), 0.0) == pytest.approx(word.count("+"))


def test_counted_grammar():
    g = parsing.WeightedGrammar.counted("S", [(["S", "A", "B"], 3), (["S", "c"], 1), (["A", "a"], 2), (["B", "b"], 5)])
    assert g.probability(["a", "b"]) == 0.75 and g.probability(["c"]) == 0.25 and g.plain().distance(["a", "b"]) == 0
    assert parsing.active_symbols(g.plain(), ["a", "b"]) == {"S": 1, "A": 1, "B": 1}


@pytest.mark.parametrize("text", ["_", "x _ y", "_ _ _", "x + _ + _", "x _", "_ + _ _ _"])
def test_holes(text):
    word = text.split()
    plain = SUMS.plain()
    every = sorted(w for w in itertools.product(["+", "x", "y"], repeat=len(word)) if all(h in ("_", t) for h, t in zip(word, w)) and derivations(SUMS, "E", w))
    assert parsing.fill_holes(plain, word) == every == parsing.fill_by_trial(plain, word)
    assert parsing.fill_holes(plain, word, most=2) == every[:2]


def test_bigrams_and_automaton_agree(spark):
    rnd = random.Random(1)
    words = [[rnd.choice("abc") for _ in range(rnd.randint(0, 6))] for _ in range(50)]
    model = parsing.Bigrams.learnt(words)
    machine = model.automaton()
    for w in words + [list("abcabcabc") * 300]:
        assert machine.score(w) == pytest.approx(model.score(w))
    assert machine.score(["z"]) == math.inf
    total = sum(math.exp(-model.score(w)) for n in range(9) for w in itertools.product("abc", repeat=n))
    assert 0.9 < total <= 1.0
    df = spark.createDataFrame([(["a", "b"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(parsing.automaton_scores(F.col("w"), machine)).collect()] == [pytest.approx(model.score(["a", "b"])), None]


def test_beam_finds_the_best_accepted_words():
    model = parsing.Bigrams.learnt([list("ab"), list("aab"), list("b"), list("abb")])
    dfa = automata.learn_dfa([list("ab"), list("aab"), list("abb"), list("aabb")], [list("b"), list("a")])
    every = sorted((model.score(w), w) for n in range(7) for w in itertools.product("ab", repeat=n) if dfa.accepts(w))[:4]
    got = parsing.beam(model, dfa, longest=6, most=4)
    assert [w for w, _ in got] == [w for _, w in every] and [c for _, c in got] == pytest.approx([c for c, _ in every])
    assert len(parsing.beam(model, dfa, steps=1)) <= 1
    free, bound = zip(*parsing.next_ranks(model, dfa, list("ab")))
    assert all(0 <= b <= f for f, b in zip(free, bound)) and parsing.next_ranks(model, dfa, list("b"))[0][1] in (-1, 0, 1)


def test_scored_repairs(spark):
    model = parsing.Bigrams.learnt([["x", "+", "y"]] * 3)
    df = spark.createDataFrame([(["x", "+"],), (None,)], "w array<string>")
    got = df.select(parsing.scored_repairs(F.col("w"), SUMS.plain(), model).alias("r")).collect()
    assert got[1]["r"] is None and got[0]["r"][0]["edits"] == 1
    words = [tuple(r["words"]) for r in got[0]["r"]]
    assert set(words) == {("x",), ("x", "+", "x"), ("x", "+", "y")} and [r["cost"] for r in got[0]["r"]] == sorted(model.score(w) for w in words)


def test_corruptions_are_seeded_distinct_and_near(spark):
    from quillstone.functions.sequences import edit_distance

    rows = [(i, [f"t{j}" for j in range(i)]) for i in range(0, 12)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    run = lambda d, **o: sorted((r["id"], r["nth"], tuple(r["broken"])) for r in pairs.corruptions(d, "id", "w", **o).collect())
    got = run(df)
    assert got == run(df.repartition(5)) and got != run(df, seed=2)
    by = {}
    for i, _, c in got:
        assert 1 <= edit_distance(rows[i][1], list(c)) <= 3
        by.setdefault(i, []).append(c)
    assert all(len(set(c)) == len(c) <= 10 for c in by.values()) and len(by[11]) == 10 and 0 not in by and 99 not in by
    assert all(len(c) < i for i, _, c in run(df, wanted=lambda c: False)) and run(df, wanted=lambda c: False) == []
    table = {("BOS", "t0", "t1"): [("SUB", "Q", 1)]}
    firsts = [pairs.corrupted(["t0", "t1"], table, pairs.Draws(1, k), 1) for k in range(50)]
    assert ["Q", "t1"] in firsts and all(c[0] in ("Q", "t0") for c in firsts)


def test_preprocessed_pairs(spark):
    rows = [("x = (1", "x = (1)"), ("x = (1", "x = (1)"), ("y = 1", "y = 2"), ("f(", "def g(:"), ("a b", "a = b"), ("a  =", "a  = "), ("q = [", "q = [\n\n\n\n\n\n1]"), (None, "x")]
    df = spark.createDataFrame(rows, "broke string, fixed string")
    run = lambda **o: sorted(r["broke"] for r in pairs.preprocessed(df, pairs.parses_as_python, X.words, lengths=(1, 80), **o).collect())
    words = lambda t: F.regexp_extract_all(t, F.lit(r"\w+|[^\w\s]"), 0)
    full = lambda **o: sorted(r["broke"] for r in pairs.preprocessed(df, pairs.parses_as_python, words, lengths=(1, 80), **o).collect())
    assert full() == ["a b", "x = (1"] and run() == []
    assert full(max_patch=0) == [] and full(vocabulary=["a", "b", "="]) == ["a b"]
    assert full(take=0) == [] and full(max_lines=10) == ["a b", "q = [", "x = (1"]
    assert full(accepts=lambda f: F.array_contains(f, ")")) == ["x = (1"]
    assert full(minimise=lambda b, f: trees.minimised(b, f)) == ["a b", "x = (1"]


def test_edit_tables(spark):
    t = spark.createDataFrame([("SUB", "'a'", "'b'", 2), ("SUB", "'a'", "'b'", 3), ("SUB", "a", "b", 9), ("DEL", "x", "", 4), ("INS", "", "'b'", 1)], "kind string, old string, new string, n long")
    assert [tuple(r) for r in pairs.common_substitutions(t).collect()] == [("'a'", "'b'", 5)]
    assert {tuple(r) for r in pairs.new_token_counts(t).collect()} == {("'b'", 6), ("b", 9), ("ε", 4)}
    four = spark.createDataFrame([(list("abcd"), list("xbde") + ["f"]), (list("ab"), list("ba"))], "b array<string>, f array<string>")
    assert pairs.with_all_edit_kinds(four).count() in (0, 1) and pairs.with_all_edit_kinds(four, 99).count() == 0


def test_data_sets_and_choices(spark):
    from quillstone.functions import coding

    df = spark.createDataFrame([(i, ["a", "b"][: 1 + i % 2], ["b"] * (i % 5)) for i in range(60)] + [(99, ["zz"], ["a"])], "id long, b array<string>, f array<string>")
    train, val = pairs.data_sets(df, lambda t: coding.charified(t, ["a", "b"]), 4)
    assert train.count() + val.count() == 60 and 0 < val.count() < 40 and train.intersect(val).count() == 0
    items = spark.createDataFrame([(1, "x"), (2, "y")], "id long, truth string")
    got = {r["id"]: (r["choices"], r["answer"]) for r in pairs.multiple_choice(items, spark.createDataFrame([(1, "p"), (1, "x"), (2, "q"), (3, "r")], "id long, word string"), "id", "truth", "word").collect()}
    assert {i: (sorted(c), c[a]) for i, (c, a) in got.items()} == {1: (["p", "x"], "x"), 2: (["q", "y"], "y")}
    good, bad = pairs.rejections(spark.createDataFrame([("x = 1",), ("x =",), ("(",)], "s string"), "s")
    assert [r["s"] for r in good.collect()] == ["x = 1"] and [tuple(r) for r in bad.collect()] == [("SyntaxError", 2)]
    assert {tuple(r) for r in pairs.agreement(df, F.size("b") > 1, F.size("f") > 1).collect()} == {(a, b, n) for a, b, n in [(False, False, 13), (False, True, 18), (True, False, 12), (True, True, 18)]}


def test_leaf_paths(spark):
    nodes = [(-1, "M"), (0, "A"), (0, "B"), (1, "x"), (1, "y"), (2, "z")]
    assert trees.leaf_paths(nodes) == [("x", "A", "y"), ("x", "A^M_B", "z"), ("y", "A^M_B", "z")]
    assert trees.leaf_paths(nodes, length=3) == [("x", "A", "y")] and trees.leaf_paths(nodes, width=0) == []
    df = spark.createDataFrame([("f(1)",), ("(",)], "s string")
    assert [r[0] is None for r in df.select(trees.path_contexts(trees.tree_nodes(F.col("s")))).collect()] == [False, True]


def test_message_passing(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "node string, x double")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    got = lambda r: dict(map(tuple, graphs.message_passing(nodes, edges, r).collect()))
    assert got(0) == {"a": 1, "b": 2, "c": 4} and got(1) == {"a": 1, "b": 3, "c": 6} and got(2) == {"a": 1, "b": 4, "c": 9}


def test_insertion_ranks_equal_enumeration(spark):
    from quillstone.operators import edits

    rnd = random.Random(9)
    items = [(i, [rnd.choice("abcd") for _ in range(rnd.randint(2, 7))]) for i in range(40)]
    count = {}
    for _, t in items:
        for w in t:
            count[w] = count.get(w, 0) + 1
    want = {}
    for i, t in items:
        at = len(t) // 2
        left = t[:at] + t[at + 1 :]
        seen = []
        for v in sorted(count, key=lambda v: (-count[v], v)):
            for p in range(len(left) + 1):
                c = left[:p] + [v] + left[p:]
                if c not in seen:
                    seen.append(c)
        want[i] = seen.index(t)
    df = spark.createDataFrame(items, "id long, truth array<string>")
    assert dict(map(tuple, edits.insertion_ranks(df, F.floor(F.size("truth") / 2).cast("int")).collect())) == want


def test_evaluated_candidates(spark):
    truth = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, ["x"], ["y"])], "id long, w array<string>, truth array<string>")
    scored = spark.createDataFrame([(1, ["a", "c"], 1, 0.5), (1, ["a", "b"], 1, 0.7), (2, ["z"], 1, 0.1)], "id long, candidate array<string>, edits int, score double")
    got = {r["dist"]: (r["pos"], r["high"], r["neg"]) for r in pairs.evaluated(truth, scored, 2).collect()}
    assert got == {1: (1, 0, 1)}
    assert [tuple(r)[2:5] for r in pairs.evaluated(truth, scored, 1).collect()] == [(0, 1, 1)]
