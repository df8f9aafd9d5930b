"""Validity predicates of source text and token sequences, and filters by them."""

from __future__ import annotations

import token as python_token

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coding import python_token_name
from .lexers import lexemes, rendered_python
from .sequences import python_error, python_error_place

#: Kinds of tokens that stand for themselves when a sequence of numbers is rendered.
_SYMBOLS = {n: s for s, n in python_token.EXACT_TOKEN_TYPES.items()}


def python_source(source: Column) -> Column:
    """The text parses as Python."""
    return python_error(source).isNull()


def python_tokens(tokens: Column) -> Column:
    """Tokens joined by spaces parse as Python; NEWLINE tokens end lines."""
    return python_source(F.regexp_replace(F.array_join(tokens, " "), r" ?\bNEWLINE\b ?", "\n"))


def python_numbers(numbers: Column) -> Column:
    """A sequence of the tokenizer module's token numbers, operators by their exact number, can be rendered as valid Python."""
    symbols = F.create_map(*[x for n, s in sorted(_SYMBOLS.items()) for x in (F.lit(n), F.lit(s))])
    kinds = F.transform(numbers, lambda n: F.coalesce(F.element_at(symbols, n), python_token_name(n), F.lit("?")))
    return python_source(rendered_python(kinds))


def python_first_error(source: Column) -> Column:
    """0-based character of the first error, -1 for valid text."""
    return F.coalesce(python_error_place(source), F.lit(-1))


def _message(source: pa.Array) -> pa.Array:
    out = []
    for s in source.to_pylist():
        try:
            compile(s or "", "<snippet>", "exec", dont_inherit=True)
            out.append("")
        except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
            out.append(f"{type(e).__name__}: {getattr(e, 'msg', e)}")
    return pa.array(out, pa.string())


def python_message(source: Column) -> Column:
    """Type and text of the error, empty for valid text."""
    return F.arrow_udf(_message, "string")(source)


def balanced(source: Column) -> Column:
    """Brackets outside strings and comments match in kind and order."""
    found = F.filter(lexemes(source), lambda t: t.isin("(", ")", "[", "]", "{", "}"))
    opener = F.create_map(F.lit(")"), F.lit("("), F.lit("]"), F.lit("["), F.lit("}"), F.lit("{"))
    step = lambda open_, t: (
        F.when(open_ == "!", open_).when(t.isin("(", "[", "{"), F.concat(t, open_)).when(F.substring(open_, 1, 1) == F.element_at(opener, t), F.substr(open_, F.lit(2))).otherwise("!"))
    return F.aggregate(found, F.lit(""), step) == ""


def java_like(source: Column, strict: bool = False) -> Column:
    """Approximately valid Java or Kotlin, without a compiler: brackets match and strings end; strictly also each statement line
    ends in a semicolon, a brace, a comma or an operator."""
    ends = ~F.exists(lexemes(source), lambda t: t.isin('"', "'"))  # a lone quote is an unclosed string
    fine = balanced(source) & ends
    if not strict:
        return fine
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.trim(F.regexp_replace(x, "//.*$", ""))), lambda x: x != "")
    return fine & F.forall(lines, lambda x: x.rlike(r"[;{},(:&|+=\-*/]$|^@|^}|\)$"))


VALIDITY = {"python": python_source, "java": java_like, "kotlin": java_like}


def filter_valid(df: DataFrame, source: str, language: str = "java", strict: bool = False) -> DataFrame:
    """Rows whose source is valid in the language; the number of rows, not a clock, bounds the work."""
    valid = VALIDITY[language]
    return df.where(valid(F.col(source), strict) if valid is java_like else valid(F.col(source)))
