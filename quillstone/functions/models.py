"""The surface of text models as DataFrame operators: a client for each partition, batches, retries, a memo.

A model is any object with the methods used; ``BigramModel`` is one that needs no server and stands in for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.parsing import Bigrams


class TextModel(Protocol):
    def next_tokens(self, prefix: Sequence[str], k: int) -> list[tuple[str, float]]:
        """The k likeliest next tokens with their log-scores, best first."""

    def score(self, tokens: Sequence[str]) -> float:
        """Negative log-score of a sequence."""


@dataclass(frozen=True)
class BigramModel:
    bigrams: Bigrams

    def next_tokens(self, prefix: Sequence[str], k: int) -> list[tuple[str, float]]:
        last = prefix[-1] if prefix else "<begin>"
        able = sorted({b for _, b in self.bigrams.counts}, key=lambda b: (self.bigrams.cost(last, b), b))
        return [(b, -self.bigrams.cost(last, b)) for b in able[:k]]

    def score(self, tokens: Sequence[str]) -> float:
        return self.bigrams.score(tokens)


def retried(call: Callable, times: int = 3, wait: float = 0.5):
    """The call's result; failures of the connection are tried again, the last one is raised."""
    for left in range(times - 1, -1, -1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if not left:
                raise
            time.sleep(wait)
    return None


def completed(model: TextModel, prefix: Sequence[str], most: int = 50, stop: str = "<end>") -> list[str]:
    """Likeliest tokens one after the other until the stop token."""
    out = list(prefix)
    for _ in range(most):
        token = model.next_tokens(out, 1)[0][0]
        if token == stop:
            break
        out.append(token)
    return out[len(prefix) :]


def filled(model: TextModel, tokens: Sequence[str], hole: str = "_") -> list[str]:
    """Holes filled from left to right, each with the token that makes the text up to its right neighbour likeliest."""
    out = list(tokens)
    for i, t in enumerate(out):
        if t == hole:
            able = [w for w, _ in model.next_tokens(out[:i], 20) if w != "<end>"]
            after = out[i + 1 : i + 2]
            out[i] = min(able, key=lambda w: (model.score([*out[:i], w, *(a for a in after if a != hole)]), w)) if able else hole
    return out


def ask(df: DataFrame, make: Callable[[], TextModel], column: str, answer: Callable[[TextModel, list[str]], list[str]], into: str = "answer", memo: int = 10_000) -> DataFrame:
    """``df`` with the model's answer (array<string>) to a token array.  A partition makes one client; equal questions are asked
    once while the memo holds them; null questions get null."""
    kept = [f for f in df.schema.fields if f.name != into]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = None, {}
        for b in batches:
            out = []
            for tokens in b.column(column).to_pylist():
                key = None if tokens is None else tuple(tokens)
                if key is not None and key not in known:
                    model = model or make()
                    if len(known) >= memo:
                        known.clear()
                    known[key] = retried(lambda tokens=tokens, model=model: answer(model, tokens))
                out.append(None if key is None else known[key])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out, pa.list_(pa.string()))], [*(f.name for f in kept), into])

    return df.mapInArrow(run, f"{fields}, `{into}` array<string>")
