"""Automata and grammars against brute force."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from quillstone.operators import automata
from quillstone.plans.evaluation import DYCK


def _balanced(w):
    depth = 0
    for c in w:
        depth += 1 if c == "(" else -1
        if depth < 0:
            return False
    return bool(w) and not depth


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_grammar_distance_equals_brute_force():
    words = [w for n in range(1, 11) for w in product("()", repeat=n) if _balanced(w)]
    for n in range(6):
        for w in product("()x", repeat=n):
            assert DYCK.distance(w) == min(_lev(w, v) for v in words), w


def test_learnt_automaton_fits_its_words():
    dfa = automata.learn_dfa(["", "ab", "abab"], ["a", "b", "ba", "aba", "aa", "bb", "abb"])
    assert all(dfa.accepts("ab" * n) for n in range(6))
    assert not any(dfa.accepts(w) for w in ("a", "b", "ba", "aba", "aa", "bb", "abb"))
    assert not automata.learn_dfa([]).accepts("")


@pytest.mark.parametrize("tokens, ok, edits", [(["(", ")"], True, 0), (["("], False, 1), ([], False, 2), (None, False, None)])
def test_columns(spark, tokens, ok, edits):
    dfa = automata.learn_dfa(["()"], ["(", "", ")"])
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    row = df.select(automata.accepted(F.col("t"), dfa).alias("a"), automata.grammar_distance(F.col("t"), DYCK).alias("d")).first()
    assert (row["a"], row["d"]) == (ok, edits)


def test_repairs_equal_brute_force():
    words = [w for n in range(1, 9) for w in product("()", repeat=n) if _balanced(w)]
    for n in range(5):
        for w in product("()x", repeat=n):
            for radius in (1, 2):
                assert DYCK.repairs(w, radius) == {v: d for v in words if (d := _lev(w, v)) <= radius}, (w, radius)


def test_repairs_column(spark):
    df = spark.createDataFrame([(["("],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(automata.grammar_repairs(F.col("t"), DYCK)).collect()] == [[["(", ")"]], None]
