"""Codes of token sequences and texts: one character a token, token ids, error messages, line tokenizers, character classes."""

from __future__ import annotations

import token as python_token

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First code point of a token, sentinels around a sequence.
FIRST, OPEN, CLOSE = 33, "|", "}"


def token_numbers(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, id): distinct tokens numbered from 0 in their order; for alphabets of tokens, which are small."""
    return tokens.select(F.col(token).alias("token")).where("token is not null").distinct().withColumn("id", F.row_number().over(Window.orderBy("token")) - 1)


def _table(numbers: list[str]) -> Column:
    return F.create_map(*[x for i, t in enumerate(numbers) for x in (F.lit(t), F.lit(chr(FIRST + i)))])


def charified(tokens: Column, alphabet: list[str]) -> Column:
    """One character a token between sentinels; null if a token is not in the alphabet."""
    coded = F.transform(tokens, lambda t: F.element_at(_table(alphabet), t))
    return F.when(~F.exists(coded, lambda c: c.isNull()), F.concat(F.lit(OPEN), F.array_join(coded, ""), F.lit(CLOSE)))


def uncharified(code: Column, alphabet: list[str]) -> Column:
    """The tokens of a charified sequence; sentinels are dropped if there."""
    inner = F.regexp_replace(F.regexp_replace(code, r"\A\|", ""), r"\}\z", "")
    chars = F.filter(F.split(inner, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.get(F.array(*map(F.lit, alphabet)), F.ascii(c) - FIRST))


def drop_sentinels(tokens: Column) -> Column:
    """All but the first and the last token; none of fewer than three."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))


def error_type(message: Column) -> Column:
    """What stands before the first colon of an error message's last line."""
    return F.trim(F.substring_index(_last_line(message), ":", 1))


def error_message(message: Column) -> Column:
    """What stands after the first colon of an error message's last line; empty without a colon."""
    last = _last_line(message)
    return F.when(F.contains(last, F.lit(":")), F.trim(F.substr(last, F.instr(last, ":") + 1))).otherwise("")


def _last_line(message: Column) -> Column:
    return F.substring_index(F.regexp_replace(message, r"\s+\z", ""), "\n", -1)


def tagged(text: Column, tag: str) -> Column:
    """The texts inside the tag's pairs, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)


def python_token_id(name: Column) -> Column:
    """Number of a token kind by the name that the tokenizer's module gives it; -1 for an unknown name."""
    known = F.create_map(*[x for i, n in sorted(python_token.tok_name.items()) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.element_at(known, name), F.lit(-1))


def python_token_name(number: Column, quoted: bool = False) -> Column:
    known = F.create_map(*[x for i, n in sorted(python_token.tok_name.items()) for x in (F.lit(i), F.lit(f"'{n}'" if quoted else n))])
    return F.element_at(known, number)


def line_tokens(line: Column) -> Column:
    """Lower-cased parts of a line by character class: camel-case humps, upper runs, digits, other characters; white space goes."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\sA-Za-z0-9]"), 0), lambda t: F.lower(t))


def normalized_line(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t]+\z", "")


def whitespace_tokens(text: Column) -> Column:
    """Cut at each single space; neighbours of repeated spaces are empty tokens."""
    return F.split(text, " ", -1)


def control_count(text: Column) -> Column:
    """Control and format characters other than tab, newline and carriage return."""
    return F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}]")) - F.regexp_count(text, F.lit(r"[\t\n\r]"))


def punctuation_count(text: Column) -> Column:
    """ASCII marks and symbols, and punctuation of other scripts."""
    return F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]|[\p{P}&&[^\x00-\x7F]]"))


def white_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[ \t\n\r]|\p{Zs}")) - F.regexp_count(text, F.lit(" "))


def padded(values: Column, size: int) -> Column:
    """The first values, filled up with zeros."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), size)), 1, size)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash of the keys: the same on every run and cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def random_matrix(spark, rows: int, columns: int, seed: int = 1) -> DataFrame:
    """(i, j, x): a matrix of seeded uniform numbers, one row a cell."""
    cells = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("j"))
    return cells.withColumn("x", uniform(F.lit(seed), F.col("i"), F.col("j")))


def synonyms(words: DataFrame, table: DataFrame, depth: int = 3) -> DataFrame:
    """``words(word)``, ``table(word, synonym)`` -> (word, synonym, steps): synonyms of synonyms up to depth, nearest steps first found."""
    pairs = table.select("word", "synonym").unionByName(table.select(F.col("synonym").alias("word"), F.col("word").alias("synonym"))).distinct()
    found = newest = words.select("word", F.col("word").alias("synonym"), F.lit(0).alias("steps"))
    for step in range(1, depth + 1):
        reached = newest.select("word", F.col("synonym").alias("at")).join(pairs.withColumnRenamed("word", "at"), "at").select("word", "synonym").distinct()
        newest = reached.join(found.select("word", "synonym"), ["word", "synonym"], "left_anti").withColumn("steps", F.lit(step))
        found = found.unionByName(newest)
    return found.where("steps > 0")


def synonymized(tokens: Column, table: Column) -> Column:
    """Tokens with those of a map<token, synonym> replaced."""
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))
