"""Trees, smallest fixes and projections on small inputs."""

import ast
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import trees
from quillstone.operators import projection, stats


def test_tree_nodes(spark):
    rows = [("x = 1 + y",), ("x = (",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(trees.tree_nodes(F.col("t"))).collect()]
    tree = ast.parse("x = 1 + y")
    assert sorted(n.kind for n in got[0]) == sorted(type(n).__name__ for n in ast.walk(tree))
    assert got[0][0].parent == -1 and all(n.parent < n.id for n in got[0])
    assert got[1] is None and [n.kind for n in got[2]] == ["Module"] == [n.kind for n in got[3]]


def test_smallest_fix():
    assert trees.smallest_fix("x = ( 1".split(), "y = ( 1 )".split()) == "x = ( 1 )".split()
    assert trees.smallest_fix("x = 1".split(), "y = 2".split()) == "x = 1".split()
    long = [f"a{i}" for i in range(20)]
    got = trees.smallest_fix(long, [x.upper() for x in long], valid=lambda t: "A3" in t and "A9" in t)
    assert sum(x != y for x, y in zip(long, got)) == 2


def test_smallest_fix_equals_fix_when_nothing_less_is_valid():
    for a, b in product(product("xy", repeat=2), repeat=2):
        assert trees.smallest_fix(list(a), list(b), valid=lambda t: t == list(b)) == list(b)


@pytest.mark.parametrize("n", [1, 40])
def test_principal_axes(spark, n):
    x = np.random.default_rng(1).normal(size=(n, 3)) * [5, 2, 0.1] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    mean, axes = projection.principal_axes(df, 3)
    assert np.allclose(mean, x.mean(axis=0))
    if n > 1:
        _, _, right = np.linalg.svd(x - x.mean(axis=0))
        assert np.allclose(np.abs(axes @ right[:2].T), np.eye(2), atol=1e-6)
    got = {r.vec_id: r.coordinates for r in projection.project(df, "vec_id", mean, axes).collect()}
    assert np.allclose([got[i] for i in range(n)], (x - mean) @ axes.T)


def test_rebalanced_equals_brute_force(spark):
    import hashlib

    rows = [(i, "ab"[i % 3 == 0]) for i in range(50)] + [(None, "a")]
    df = spark.createDataFrame(rows, "id long, label string")
    got = sorted((r.id, r.label) for r in stats.rebalanced(df, "label", F.coalesce(F.md5(F.col("id").cast("string")), F.lit("g")), F.col("id")).collect())
    want = [sorted((hashlib.md5(str(i).encode()).hexdigest() if i is not None else "g", i, v) for i, v in rows if v == label)[:17] for label in "ab"]
    assert got == sorted((i, v) for w in want for _, i, v in w)
