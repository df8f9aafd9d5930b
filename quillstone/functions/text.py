"""Scalar functions on text as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control-flow tokens, brackets, comment openers.
CONTROL = ["if", "else", "while", "case", "for", "switch", "do", "continue", "break", "&&", "||", "?", ":", "catch", "finally", "throw", "throws", "default", "return"]
BRACKETS = ["(", "{", "[", ")", "}", "]"]
COMMENT_PREFIXES = ("//", "* ", "/*")
# Fixed value: the keys column by column, three rows each.
KEYBOARD = ".LO,KIMJUNHYBGTVFRCDEXSWZAQ"
# Reserved words of Java-like code.
RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()


def words(text: Column) -> Column:
    """ASCII word tokens."""
    return F.regexp_extract_all(text, F.lit(r"\w+"), 0)


def word_pieces(text: Column) -> Column:
    """Words and single other characters, nothing dropped."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\w+|\W"), 0)


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def bracket_balance(text: Column) -> Column:
    """Opening minus closing brackets of all kinds."""
    total = F.lit(0).cast("long")
    for o, c in ("()", "[]", "{}"):
        total = total + count_of(text, o) - count_of(text, c)
    return total


def brackets_and_depth(text: Column) -> Column:
    """struct(balance, depth): depth is measured before the bracket that opens it, so it is the true depth less one."""
    step = lambda a, c: F.struct(
        (a["balance"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("balance"), F.when(c.isin("(", "[", "{"), F.greatest(a["depth"], a["balance"])).otherwise(a["depth"]).alias("depth"))
    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("balance"), F.lit(0).alias("depth")), step)


def nontrivial_statement(text: Column, depth: int = 2) -> Column:
    """Ends with a semicolon, has balanced brackets and nests at least depth + 2 deep."""
    b = brackets_and_depth(text)
    return F.endswith(F.trim(text), F.lit(";")) & (b["balance"] == 0) & (F.lit(depth) < b["depth"])


def approx_cyclomatic(text: Column) -> Column:
    """Number of control-flow tokens and brackets among words and single other characters."""
    return F.size(F.filter(word_pieces(text), lambda t: t.isin(*CONTROL, *BRACKETS))).cast("long")


def is_comment_or_empty(line: Column, prefixes: tuple[str, ...] = COMMENT_PREFIXES) -> Column:
    """At most one character, or one of the two-character prefixes, after trimming."""
    t = F.trim(line)
    return (F.length(t) <= 1) | F.substring(t, 1, 2).isin(*prefixes)


def matches_whole(line: Column, pattern: str) -> Column:
    """The pattern matches all of the line."""
    return line.rlike(rf"\A(?:{pattern})\z")


def visible_chars(text: Column) -> Column:
    return F.regexp_replace(text, "[^!-~]", "")


def visible_length(text: Column) -> Column:
    """Length without terminal colour codes."""
    return F.length(F.regexp_replace(text, "\x1b\\[[0-9;]*m", ""))


def without_cjk(text: Column) -> Column:
    return ~text.rlike(r"[\x{4E00}-\x{9FA5}]")


def extension(uri: Column) -> Column:
    return F.substring_index(uri, ".", -1)


def file_name(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def preview(text: Column, query: str, window: int = 10) -> Column:
    """First hit with up to window characters on each side; null without a hit."""
    at = F.instr(text, query)
    return F.when(at > 0, F.substr(text, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)) + len(query) + window))


def bin10(n: Column) -> Column:
    return F.floor((n + 1) / 10) * 10


def bucket10(n: Column) -> Column:
    return F.floor(n / 10) * 10


def identifiers(text: Column) -> Column:
    """Word tokens longer than one character, not starting with a digit, not reserved."""
    return F.filter(words(text), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]") & ~t.isin(*RESERVED))


# Licence marks in order of precedence.
LICENSES = (("Apache ", "Apache"), ("GPL ", "GPL"), ("MIT license", "MIT"), ("Copyright (", "Custom"))
#: Marks of licence lines in prose corpora.
CORPUS_LICENSES = (("Apache License", "Apache"), ("GNU General Public License", "GPL"), ("MIT License", "MIT"), ("icensed under", "Custom"), ("rights reserved", "Custom"))


def license_class(text: Column, marks: tuple[tuple[str, str], ...] = LICENSES) -> Column:
    """The class of the first mark that the text holds, ``?`` without one."""
    out = F.lit("?")
    for mark, name in reversed(marks):
        out = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def camel_tokens(text: Column) -> Column:
    """Character-class split: capitalised words, upper runs, digits, white space, other characters."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[ \t\n\r]+|."), 0)


def normal_form(tokens: Column, names: Column, joiner: str = "") -> Column:
    """Tokens renamed to their first position among names, from 0; without a joiner, as the metric has it, 1 2 and 12 look alike."""
    return F.array_join(F.transform(tokens, lambda t: (F.array_position(names, t) - 1).cast("string")), joiner)


def normal_form_distance(a: Column, b: Column, joiner: str = "") -> Column:
    """Levenshtein distance of the two texts after renaming tokens to shared first-occurrence numbers."""
    x, y = camel_tokens(a), camel_tokens(b)
    names = F.array_distinct(F.concat(x, y))
    return F.levenshtein(normal_form(x, names, joiner), normal_form(y, names, joiner))


def rouge_recall(reference: Column, candidate: Column) -> Column:
    """Share of the reference's token set found in the candidate's."""
    return F.size(F.array_intersect(reference, candidate)) / F.greatest(F.size(F.array_distinct(reference)), F.lit(1))


def keyboard_distance(a: Column, b: Column, layout: str = KEYBOARD) -> Column:
    """Distance of two keys by their places in the layout: 4 units a row, two thirds of a unit a place, times 4.76."""
    at = lambda c: F.instr(F.lit(layout), c) - 1
    dx, dy = (at(a) % 3 - at(b) % 3) * 4.0, (at(a) - at(b)) * (2.0 / 3.0)
    return F.sqrt(dx * dx + dy * dy) * 4.76


def swap_plus_minus(text: Column) -> Column:
    return F.translate(text, "+", "-")


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def l1_normalised(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(v, lambda x: x.cast("double") / total)


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive n-token strings, space-joined; none if there are fewer tokens."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), size)
    for k in range(1, n):  # shifted copies zipped, not looked up one by one
        grams = F.zip_with(grams, F.slice(tokens, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def bigrams(tokens: Column) -> Column:
    """A generator of (a, b): neighbouring tokens as columns, without a lambda."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.inline(F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("a"), F.slice(tokens, F.lit(2), n).alias("b"))).alias("a", "b")


def overlapping_chunks(tokens: Column, width: int = 760, hop: int = 380) -> Column:
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, width))


def padded_chars(text: Column, size: int, vocabulary: int = 256) -> Column:
    """Character codes modulo the vocabulary, zero-padded or cut to size."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % vocabulary)
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), size)), 1, size)


def documentation(lines: Column) -> Column:
    """The comment lines of a text's lines; empty ones don't count as comments here."""
    return F.filter(lines, lambda x: (F.length(F.trim(x)) > 1) & F.substring(F.trim(x), 1, 2).isin(*COMMENT_PREFIXES))


def code_lines(lines: Column) -> Column:
    """The lines that are no comment."""
    return F.filter(lines, lambda x: (F.length(F.trim(x)) <= 1) | ~F.substring(F.trim(x), 1, 2).isin(*COMMENT_PREFIXES))


def until_last_call(text: Column) -> Column:
    """Up to and with the last opening bracket; all of a text without one."""
    return F.when(F.contains(text, F.lit("(")), F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "(", -1))))).otherwise(text)


def brackets_replaced(text: Column, seed: Column, n: int, by: str) -> Column:
    """``n`` of the text's brackets, picked by hash, replaced (by a mask, or by nothing); fewer brackets: all of them."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    marked = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.when(c.isin(*BRACKETS), F.md5(F.concat_ws("-", seed, i))).alias("h")))
    picked = F.slice(F.array_sort(F.filter(F.transform(marked, lambda m: m["h"]), lambda h: h.isNotNull())), 1, n)
    return F.array_join(F.transform(marked, lambda m: F.when(m["h"].isNotNull() & F.array_contains(picked, m["h"]), F.lit(by)).otherwise(m["c"])), "")


def rouge_recall_with_synonyms(reference: Column, candidate: Column, synonyms: Column) -> Column:
    """Share of the reference's token set found in the candidate's, a token also counting by any of its synonyms (map<token, array>)."""
    found = F.filter(F.array_distinct(reference), lambda t: F.array_contains(candidate, t) | F.coalesce(F.arrays_overlap(F.element_at(synonyms, t), candidate), F.lit(False)))
    return F.size(found) / F.greatest(F.size(F.array_distinct(reference)), F.lit(1))
