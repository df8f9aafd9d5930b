"""Rewrites on small sources."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import rewrites as R


@pytest.mark.parametrize("fn, text, want", [
    (R.reverse_arguments, "f(a, b, c); g(x, y)", "f(c, b, a); g(x, y)"),
    (R.reverse_arguments, "f(a)", "f(a)"),
    (R.swap_independent_lines, "a = 1\nb = 2\n  c\nd\ne", "b = 2\na = 1\n  c\nd\ne"),
    (R.swap_independent_lines, "a = 1\nb = a", "a = 1\nb = a"),
    (R.shift_loop_bounds, "for i in range(1, 9):\n  x 1", "for i in range(1, 10):\n  x 1"),
    (R.shift_loop_bounds, "", ""),
    (R.reverse_arguments, None, None),
    (lambda t: R.mask_window(t, F.lit(5)), "ab", "<mask>"),
    (lambda t: R.add_logging(t, F.lit(0)), "", ""),
    (lambda t: R.mutate(t, F.lit(0)), None, None),
])
def test_rewrite(spark, fn, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0] == want


def test_shuffle_keeps_lines_and_repeats(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd")], "id long, t string")
    out = [df.select(R.shuffle_lines(F.col("t"), R.seed("id"))).first()[0] for _ in range(2)]
    assert out[0] == out[1] and sorted(out[0].split("\n")) == list("abcd")
