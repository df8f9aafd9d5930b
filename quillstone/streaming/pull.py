"""A pull source: an endless, seeded sequence of corrupted token rows, read a fixed number of rows a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.pairs import Draws, corrupted


class PulledRows(SimpleDataSourceStreamReader):
    """Row n is a fixed function of the seed and n, so a replayed batch is the same batch."""

    def __init__(self, options: dict[str, str]):
        self.words = options.get("words", "a b c").split()
        self.seed, self.rows, self.most = options.get("seed", "1"), int(options.get("rows", "100")), int(options.get("most", str(1 << 62)))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"n": min(start["n"] + self.rows, self.most)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(n, " ".join(corrupted(self.words, {}, Draws(self.seed, n)))) for n in range(start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        pass  # nothing to forget: rows are made anew


class PullSource(DataSource):
    """``spark.dataSource.register(PullSource)``, then ``spark.readStream.format("corruptions")`` with options words, seed, rows, most."""

    @classmethod
    def name(cls) -> str:
        return "corruptions"

    def schema(self) -> str:
        return "n long, text string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PulledRows(dict(self.options))
