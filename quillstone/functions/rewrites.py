"""Source rewrites as Columns.  Every random choice is a fixed function of a seed column, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # with 48271 the minimal standard generator


def seed(*key: str) -> Column:
    """A seed below 16^7 from key columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 7), 16, 10).cast("long")


def draw(seed: Column, i: Column, below: int) -> Column:
    """The i-th draw of a seed, from 0 to below - 1."""
    return F.pmod((seed + i) * 48271 % PRIME, F.lit(below))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def mutate(text: Column, seed: Column) -> Column:
    """Three characters in ten that aren't white space become a letter."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    put = lambda c, i: F.when(c.rlike(r"\S") & (draw(seed, i, 10) < 3), F.substr(letters, (draw(seed, i + 1, 26) + 1).cast("int"), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), put), "")


def shuffle_lines(text: Column, seed: Column) -> Column:
    """Lines in the order of their draws."""
    keyed = F.transform(split_lines(text), lambda x, i: F.struct(draw(seed, i * 7919, 1000003).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "\n")


def swap_independent_lines(text: Column) -> Column:
    """Lines 2i and 2i + 1 change places if they have the same indent and share no alphabetic word."""
    lines = split_lines(text)
    words = lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z]+"), 0)
    indent = lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))

    def at(x: Column, i: Column) -> Column:
        other = F.get(lines, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return F.when((indent(x) == indent(other)) & ~F.arrays_overlap(words(x), words(other)), other).otherwise(x)

    return F.array_join(F.transform(lines, at), "\n")


def reverse_arguments(text: Column) -> Column:
    """The arguments of the first call with two or more, in reverse; other texts are unchanged."""
    inner = F.regexp_extract(text, r"\(([^()]*, [^()]*)\)", 1)
    back = F.array_join(F.reverse(F.split(inner, ", ", -1)), ", ")
    return F.when(inner != "", F.replace(text, F.concat(F.lit("("), inner, F.lit(")")), F.concat(F.lit("("), back, F.lit(")")))).otherwise(text)


def shift_loop_bounds(text: Column) -> Column:
    """The last digit of each line that names a loop grows by 1 to 3 (by the line's length)."""
    last = "^(.*)([0-9])([^0-9]*)$"
    grown = lambda x: F.concat(F.regexp_extract(x, last, 1), (F.regexp_extract(x, last, 2).cast("int") + 1 + F.length(x) % 3).cast("string"), F.regexp_extract(x, last, 3))
    return F.array_join(F.transform(split_lines(text), lambda x: F.when(x.rlike(r"\b(for|while)\b") & x.rlike(last), grown(x)).otherwise(x)), "\n")


def add_logging(text: Column, seed: Column, end: str = ";") -> Column:
    """After three statements in ten (lines with the given end) a line that prints the statement's number."""
    def at(x: Column, i: Column) -> Column:
        said = F.concat(x, F.lit('\nprintln("line '), i.cast("string"), F.lit('");'))
        return F.when(F.endswith(x, F.lit(end)) & (draw(seed, i, 10) < 3), said).otherwise(x)

    return F.array_join(F.transform(split_lines(text), at), "\n")


def mask_window(text: Column, seed: Column, width: int = 3) -> Column:
    """A run of characters, its place drawn from the seed, becomes a mask; shorter texts become the mask."""
    at = draw(seed, F.lit(0), 1 << 30) % F.greatest(F.length(text) - width + 1, F.lit(1))
    return F.concat(F.substr(text, F.lit(1), at.cast("int")), F.lit("<mask>"), F.substr(text, (at + width + 1).cast("int")))
