"""All queries of the engine, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import datasets, distributions, evaluation, grammars, records, relational, repairs, rewriting, scores, search, structure, textstats, tokens

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [search, relational, textstats, repairs, evaluation, rewriting, tokens, structure, scores, records, grammars, distributions, datasets]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
