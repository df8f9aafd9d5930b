"""Sequence alignment and distances without a built-in: Arrow UDFs over token arrays and strings."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edit_distance(a, b, limit: int | None = None) -> int | None:
    """Unit-cost edit distance with one row of costs; with a limit only the band around the diagonal, None beyond it."""
    if len(a) < len(b):
        a, b = b, a
    band = len(a) if limit is None else limit
    if len(a) - len(b) > band:
        return None
    far = len(a) + len(b) + 1
    row = [j if j <= band else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - band), min(len(b), i + band)
        diagonal, row[lo - 1] = row[lo - 1], i if lo == 1 and i <= band else far
        for j in range(lo, hi + 1):
            above = row[j] if j <= i - 1 + band else far
            diagonal, row[j] = row[j], min(above + 1, row[j - 1] + 1, diagonal + (x != b[j - 1]))
        if hi < len(b):
            row[hi + 1] = far
    return row[-1] if limit is None or row[-1] <= limit else None


def alignment(a: list[str], b: list[str]) -> list[tuple[str, int, str, str]]:
    """Minimal unit-cost edits that turn a into b: (INS | DEL | SUB, position in a, old, new).

    Equal ends are set aside; costs are kept only within the band of the true distance, found by doubling, so long
    texts with few edits take little memory."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    band = max(1, abs(len(x) - len(y)))
    while (d := edit_distance(x, y, band)) is None:
        band *= 2
    n, m = len(x), len(y)
    far = n + m + 1
    cost: list[dict[int, int]] = []
    for i in range(n + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - d), min(m, i + d) + 1):
            if not i or not j:
                row[j] = i + j
            else:
                row[j] = min(cost[i - 1].get(j, far) + 1, row.get(j - 1, far) + 1, cost[i - 1].get(j - 1, far) + (x[i - 1] != y[j - 1]))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1].get(j - 1, far) + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append(("SUB", head + i, x[i], y[j]))
        elif i and cost[i][j] == cost[i - 1].get(j, far) + 1:
            i -= 1
            out.append(("DEL", head + i, x[i], ""))
        else:
            j -= 1
            out.append(("INS", head + i, "", y[j]))
    return out[::-1]


# Codes of an alignment's steps, one a token: kept, changed, dropped, added.
CODES = {"KEEP": "=", "SUB": "~", "DEL": "-", "INS": "+"}


def alignment_codes(a: list[str], b: list[str]) -> str:
    """The alignment as one code a step."""
    out, at = [], 0
    for kind, pos, _, _ in alignment(a, b):
        out += [CODES["KEEP"]] * (pos - at) + [CODES[kind]]
        at = pos + (kind != "INS")
    return "".join(out + [CODES["KEEP"]] * (len(a) - at))


def aligned(a: Column, b: Column) -> Column:
    """Alignment codes of two token arrays; null for a null side."""
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if u is None or v is None else alignment_codes(u, v) for u, v in zip(x.to_pylist(), y.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(a, b)


def _lcs_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else 1 - lcs_length(x, y) / max(len(x), len(y), 1) for x, y in pairs], pa.float64())


def lcs_distance(a: Column, b: Column) -> Column:
    """1 - LCS / longer length, over characters or tokens; null for a null side."""
    return F.arrow_udf(_lcs_distance, "double")(a, b)


_EDIT = pa.list_(pa.struct([("kind", pa.string()), ("pos", pa.int32()), ("old", pa.string()), ("new", pa.string())]))


#: Pairs of a batch that are Python objects at once.
SOME = 64


def _some(a: pa.Array, b: pa.Array):
    """Pairs of token lists, null ones empty, some rows at a time."""
    for at in range(0, len(a), SOME):
        yield [(x or [], y or []) for x, y in zip(a.slice(at, SOME).to_pylist(), b.slice(at, SOME).to_pylist())]


def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    parts = [pa.array([[dict(zip(("kind", "pos", "old", "new"), e)) for e in alignment(x, y)] for x, y in rows], _EDIT) for rows in _some(a, b)]
    return pa.concat_arrays(parts) if parts else pa.array([], _EDIT)


def distances(a: Column, b: Column, limit: int) -> Column:
    """Edit distance of two token arrays, null beyond the limit: as many as ``edits`` has, without the alignment's table."""
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([edit_distance(u, v, limit) for rows in _some(x, y) for u, v in rows], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def edits(a: Column, b: Column) -> Column:
    """array<struct<kind, pos, old, new>> that turns token array a into b."""
    return F.arrow_udf(_edits, "array<struct<kind:string,pos:int,old:string,new:string>>")(a, b)


def longest_common(strings: list[str | None]) -> str:
    """The longest substring of all strings, the leftmost in the shortest: its length by binary search, since every part of
    a common substring is common."""
    group = [s or "" for s in strings]
    if not group:
        return ""
    shortest = min(group, key=len)

    def common(n: int) -> str | None:
        shared = {s for s in (shortest[i : i + n] for i in range(len(shortest) - n + 1))}
        for other in group:
            shared = {s for s in shared if s in other} if len(shared) * n < len(other) else shared & {other[i : i + n] for i in range(len(other) - n + 1)}
            if not shared:
                return None
        return min(shared, key=shortest.index)

    low, high, best = 0, len(shortest), ""
    while low < high:
        mid = (low + high + 1) // 2
        found = common(mid)
        if found is None:
            high = mid - 1
        else:
            low, best = mid, found
    return best


def common_substring(strings: Column) -> Column:
    """The longest substring common to all strings of an array; a null string is empty."""
    return F.arrow_udf(lambda batch: pa.array([longest_common(g or []) for g in batch.to_pylist()], pa.string()), "string")(strings)


def _valid(source: pa.Array) -> pa.Array:
    out = []
    for s in source.to_pylist():
        try:
            compile(s or "", "<snippet>", "exec", dont_inherit=True)
            out.append(None)
        except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
            out.append(type(e).__name__)
    return pa.array(out, pa.string())


def python_error(source: Column) -> Column:
    """Null for source that parses as Python, else the error's type."""
    return F.arrow_udf(_valid, "string")(source)


def _first_error(source: pa.Array) -> pa.Array:
    out = []
    for s in source.to_pylist():
        at = None
        try:
            compile(s or "", "<snippet>", "exec", dont_inherit=True)
        except SyntaxError as e:
            lines = (s or "").split("\n")
            line = min(max(e.lineno or 1, 1), len(lines))
            at = sum(len(x) + 1 for x in lines[: line - 1]) + max((e.offset or 1) - 1, 0)
        except (ValueError, MemoryError, RecursionError):
            at = 0
        out.append(at)
    return pa.array(out, pa.int32())


def python_error_place(source: Column) -> Column:
    """0-based character at which reading the source as Python fails first; null for source that parses."""
    return F.arrow_udf(_first_error, "int")(source)


def _assignment(cost: list[list[float]]) -> float:
    """Least total cost of pairing rows with columns, as many of each (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[j]:
            used[j] = True
            delta, nxt = float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = cost[match[j] - 1][k - 1] - u[match[j]] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return sum(cost[match[k] - 1][k - 1] for k in range(1, n + 1))


def earth_mover(a: list[list[float]], b: list[list[float]]) -> float:
    """Wasserstein distance of two sets of points of equal weight: each point is split so that both sides have as many."""
    if not a or not b:
        return float("nan")
    m = math.lcm(len(a), len(b))
    x, y = [p for p in a for _ in range(m // len(a))], [p for p in b for _ in range(m // len(b))]
    return _assignment([[math.dist(p, q) for q in y] for p in x]) / m


def point_set_distances(a: Column, b: Column) -> Column:
    """struct(least, mover) of two arrays of vectors: the smallest distance of two points, and the earth mover's; for small sets."""
    kind = pa.struct([("least", pa.float64()), ("mover", pa.float64())])

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [None if not p or not q else {"least": min(math.dist(s, t) for s in p for t in q), "mover": earth_mover(p, q)} for p, q in zip(x.to_pylist(), y.to_pylist())]
        return pa.array(out, kind)

    return F.arrow_udf(run, "struct<least:double,mover:double>")(a, b)
