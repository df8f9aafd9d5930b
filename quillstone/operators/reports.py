"""Result tables as text: LaTeX rows of a pivot, JSON of distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import score_histogram

_SPECIAL = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def latex_table(table: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A report's table as a LaTeX tabular; reports are small, ``most`` rows at most are rendered."""
    rows = table.limit(most).collect()

    def cell(v) -> str:
        return "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).translate(_SPECIAL)

    head = " & ".join(c.translate(_SPECIAL) for c in table.columns)
    body = "".join(f"{' & '.join(map(cell, r))} \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{l{'r' * (len(table.columns) - 1)}}}\n{head} \\\\\n\\hline\n{body}\\end{{tabular}}\n"


def distributions_json(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, json): the scores of each cell as an object of counts by score."""
    cells = score_histogram(scores.withColumn(value, F.col(value).cast("string")), value, *by)
    return cells.select(*by, F.to_json("scores").alias("json"))
