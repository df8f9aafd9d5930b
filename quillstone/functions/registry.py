"""Functions by name: rewrites, metrics, tokenizers and predicates as values, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import lexers, sequences, text, validity

REWRITES: dict[str, Callable[[Column], Column]] = {
    "same": lambda c: c, "swap_plus_minus": text.swap_plus_minus, "visible": text.visible_chars, "lower": F.lower, "until_last_call": text.until_last_call, "cleaned": lexers.cleaned}
STRING_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": F.levenshtein, "lcs": sequences.lcs_distance, "normal_form": text.normal_form_distance,
    "rouge": lambda a, b: 1.0 - text.rouge_recall(text.words(a), text.words(b))}
VECTOR_METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": text.euclid}
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words": text.words, "pieces": text.word_pieces, "camel": text.camel_tokens, "java": lexers.lexemes, "basic": lexers.basic_tokens}
PREDICATES: dict[str, Callable[[Column], Column]] = dict(validity.VALIDITY) | {"comment": text.is_comment_or_empty, "balanced": validity.balanced}


def rewritten(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A row for each rewrite that changes the column: (the columns, sct, variant)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("sct"), REWRITES[n](F.col(column)).alias("variant")) for n in names]))
    return df.select("*", each.alias("_x")).select(*df.columns, "_x.sct", "_x.variant").where(F.col("variant") != F.col(column))


@udtf(returnType="method string, line int")
class SplitMethods:
    """Table-valued parser: the methods of a text and the line at which each begins."""

    def eval(self, source: str):
        for m in lexers.sliced_methods(source or ""):
            yield m, (source[: max(source.find(m.split("\n")[0]), 0)]).count("\n")


def register(spark: SparkSession) -> list[str]:
    """Make the table function ``split_methods`` known to SQL; the names that were registered."""
    spark.udtf.register("split_methods", SplitMethods)
    return ["split_methods"]
