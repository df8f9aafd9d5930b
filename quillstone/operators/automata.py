"""Automata and grammars: state-merging inference, membership filters, error-correcting CYK.

Learning runs on the driver over the strings it is given (a bounded sample, chosen by the caller); filters and
parses run in Arrow UDFs, row by row independent, so they need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dfa:
    """Partial automaton; state 0 starts, a missing step rejects."""

    steps: dict[tuple[int, str], int]
    finals: frozenset[int]

    def accepts(self, word: Iterable[str]) -> bool:
        at = 0
        for symbol in word:
            if (at := self.steps.get((at, symbol), -1)) < 0:
                return False
        return at in self.finals


def learn_dfa(positive: Iterable[Sequence[str]], negative: Iterable[Sequence[str]] = ()) -> Dfa:
    """Regular positive and negative inference: merge states of the prefix tree, in length-lexicographic order,
    wherever no negative word becomes accepted.  No positive words: the empty language."""
    good, bad = [tuple(w) for w in positive], [tuple(w) for w in negative]
    prefixes = sorted({w[:i] for w in good for i in range(len(w) + 1)} | {()}, key=lambda w: (len(w), w))
    number = {p: i for i, p in enumerate(prefixes)}
    steps = {(number[p[:-1]], p[-1]): number[p] for p in prefixes if p}
    finals = {number[w] for w in good}
    kept = [0]
    for state in range(1, len(prefixes)):
        if state not in set(steps.values()):
            continue
        for target in kept:
            merged = _fold(steps, finals, target, state)
            if not any(Dfa(*merged).accepts(w) for w in bad):
                steps, finals = dict(merged[0]), set(merged[1])
                break
        else:
            kept.append(state)
    return Dfa(steps, frozenset(finals))


def _fold(steps: dict, finals: set, a: int, b: int) -> tuple[dict, frozenset]:
    """Merge b into a, and whatever must follow for the automaton to stay deterministic."""
    leader: dict[int, int] = {}

    def find(x: int) -> int:
        while x in leader:
            x = leader[x]
        return x

    todo = [(a, b)]
    while todo:
        x, y = sorted(map(find, todo.pop()))
        if x != y:
            leader[y] = x
        out: dict[tuple[int, str], int] = {}
        for (s, symbol), t in steps.items():
            key, t = (find(s), symbol), find(t)
            if out.setdefault(key, t) != t:
                todo.append((out[key], t))
    return {(find(s), c): find(t) for (s, c), t in steps.items()}, frozenset(map(find, finals))


def accepted(tokens: Column, dfa: Dfa) -> Column:
    """Whether the automaton accepts the token array; null arrays are rejected."""
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([t is not None and dfa.accepts(t) for t in batch.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(tokens)


@dataclass(frozen=True)
class Grammar:
    """Chomsky normal form: head -> left right, head -> token."""

    start: str
    pairs: tuple[tuple[str, str, str], ...]
    tokens: tuple[tuple[str, str], ...]

    def distance(self, word: Sequence[str]) -> int | None:
        """Fewest insertions, deletions and substitutions of tokens that give a word of the language.

        A shortest-derivation table over spans (Aho and Peterson, 1972): a span's cost for a head is that of one
        token there, of a split, or of the span without its first or last token.  None: the language is empty."""
        empty = self._insertions()
        n, heads = len(word), list(empty)
        if self.start not in empty:
            return None
        table: dict[tuple[int, int], dict[str, int]] = {(i, i): dict(empty) for i in range(n + 1)}
        for size in range(1, n + 1):
            for i in range(n - size + 1):
                j = i + size
                cost = {h: min(table[i + 1, j].get(h, 1 << 30), table[i, j - 1].get(h, 1 << 30)) + 1 for h in heads}
                if size == 1:
                    for head, token in self.tokens:
                        cost[head] = min(cost[head], int(token != word[i]))
                for k in range(i + 1, j):
                    self._relax(cost, table[i, k], table[k, j])
                while self._relax(cost, empty, cost) | self._relax(cost, cost, empty):
                    pass
                table[i, j] = cost
        return table[0, n][self.start]

    def repairs(self, word: Sequence[str], radius: int | None = None) -> dict[tuple[str, ...], int]:
        """All words of the language within radius edits of the word (default: its distance), with their distances.

        Each head and span keeps the yields whose cost fits the radius, so work grows with the number of answers;
        meant for short words and small radii."""
        limit = self.distance(word) if radius is None else radius
        if limit is None:
            return {}
        n, heads = len(word), {h for h, *_ in self.pairs} | {h for h, _ in self.tokens}
        table: dict[tuple[int, int], dict[str, dict[tuple[str, ...], int]]] = {}

        def offer(cell: dict, head: str, text: tuple[str, ...], cost: int) -> bool:
            if cost > limit or cost >= cell[head].get(text, limit + 1):
                return False
            cell[head][text] = cost
            return True

        def pair_up(cell: dict, left: dict, right: dict) -> bool:
            fresh = [(h, x + y, c + d) for h, a, b in self.pairs for x, c in left[a].items() for y, d in right[b].items() if c + d <= limit]
            return any([offer(cell, *f) for f in fresh])

        for size in range(n + 1):
            for i in range(n - size + 1):
                j = i + size
                cell: dict[str, dict[tuple[str, ...], int]] = {h: {} for h in heads}
                for head, token in self.tokens:
                    if size < 2:
                        offer(cell, head, (token,), int(size == 0 or token != word[i]))
                if size:
                    for span in ((i + 1, j), (i, j - 1)):  # drop the first or the last token
                        for head in heads:
                            for text, cost in table[span][head].items():
                                offer(cell, head, text, cost + 1)
                    for k in range(i + 1, j):
                        pair_up(cell, table[i, k], table[k, j])
                    while pair_up(cell, table[i, i], cell) | pair_up(cell, cell, table[j, j]):
                        pass
                else:
                    while pair_up(cell, cell, cell):
                        pass
                table[i, j] = cell
        return table[0, n][self.start]

    def _relax(self, cost: dict[str, int], left: dict[str, int], right: dict[str, int]) -> bool:
        changed = False
        for head, a, b in self.pairs:
            if a in left and b in right and left[a] + right[b] < cost.get(head, 1 << 30):
                cost[head] = left[a] + right[b]
                changed = True
        return changed

    def _insertions(self) -> dict[str, int]:
        """Length of each head's shortest word: the cost of inserting all of it."""
        cost = {head: 1 for head, _ in self.tokens}
        while self._relax(cost, cost, cost):
            pass
        return cost


def grammar_distance(tokens: Column, grammar: Grammar) -> Column:
    """Edits to the nearest word of the grammar, 0 for its own words; null for null arrays."""
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else grammar.distance(t) for t in batch.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(tokens)


def grammar_repairs(tokens: Column, grammar: Grammar, radius: int | None = None) -> Column:
    """Words of the grammar within the radius (default: the smallest that has one), nearest first, then by text."""
    def run(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            found = {} if t is None else grammar.repairs(t, radius)
            out.append(None if t is None else [list(w) for w in sorted(found, key=lambda w: (found[w], w))])
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(run, "array<array<string>>")(tokens)
