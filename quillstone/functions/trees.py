"""Syntax trees of Python source and smallest repairs, in Arrow UDFs (rows are independent: no shuffle)."""

from __future__ import annotations

import ast
from collections import deque
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import alignment

_NODE = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("kind", pa.string())]))


def _nodes(source: pa.Array) -> pa.Array:
    out = []
    for s in source.to_pylist():
        try:
            todo, found = deque([(-1, ast.parse(s or ""))]), []
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            todo, found = deque(), None
        while todo:  # breadth first, so that numbers follow levels
            parent, node = todo.popleft()
            found.append({"id": len(found), "parent": parent, "kind": type(node).__name__})
            todo.extend((len(found) - 1, child) for child in ast.iter_child_nodes(node))
        out.append(found)
    return pa.array(out, _NODE)


def tree_nodes(source: Column) -> Column:
    """array<struct<id, parent, kind>>, the root's parent being -1; null for source that doesn't parse."""
    return F.arrow_udf(_nodes, "array<struct<id:int,parent:int,kind:string>>")(source)


_PATHS = pa.list_(pa.struct([("start", pa.string()), ("path", pa.string()), ("end", pa.string())]))


def leaf_paths(nodes: list[tuple[int, str]], length: int = 5, width: int = 5) -> list[tuple[str, str, str]]:
    """``nodes`` as (parent, kind) by number -> (kind of a leaf, path up and down, kind of a later leaf).

    A path has at most ``length`` steps, and the branches that it takes at its top are at most ``width`` children apart."""
    children: dict[int, list[int]] = {}
    for i, (parent, _) in enumerate(nodes):
        children.setdefault(parent, []).append(i)
    place = {c: n for own in children.values() for n, c in enumerate(own)}
    order: list[int] = []
    todo = [c for c in reversed(children.get(-1, []))]
    while todo:  # leaves in text order
        i = todo.pop()
        if i not in children:
            order.append(i)
        todo.extend(reversed(children.get(i, [])))
    above = {}
    for leaf in order:
        chain, at = [leaf], leaf
        while nodes[at][0] >= 0 and len(chain) <= length:
            at = nodes[at][0]
            chain.append(at)
        above[leaf] = chain
    out = []
    for n, a in enumerate(order):
        steps = {x: d for d, x in enumerate(above[a])}
        for b in order[n + 1 :]:
            down = next((d for d, x in enumerate(above[b]) if x in steps), None)
            if down is None:
                continue
            up = steps[above[b][down]]
            if up + down <= length and up and down and place[above[b][down - 1]] - place[above[a][up - 1]] <= width:
                path = "^".join(nodes[x][1] for x in above[a][1 : up + 1]) + "".join(f"_{nodes[x][1]}" for x in reversed(above[b][1:down]))
                out.append((nodes[a][1], path, nodes[b][1]))
    return out


def path_contexts(nodes: Column, length: int = 5, width: int = 5) -> Column:
    """array<struct<start, path, end>> of a tree as ``tree_nodes`` gives it; null for null."""
    def run(batch: pa.Array) -> pa.Array:
        rows = [None if t is None else [dict(zip(("start", "path", "end"), p)) for p in leaf_paths([(n["parent"], n["kind"]) for n in t], length, width)] for t in batch.to_pylist()]
        return pa.array(rows, _PATHS)

    return F.arrow_udf(run, "array<struct<start:string,path:string,end:string>>")(nodes)


def parses(tokens: list[str]) -> bool:
    try:
        ast.parse(" ".join(tokens))
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


def _applied(tokens: list[str], patch) -> list[str]:
    out, at = [], 0
    for kind, pos, _, new in patch:
        out += tokens[at:pos]
        at = pos + (kind != "INS")
        out += [new] if kind != "DEL" else []
    return out + tokens[at:]


def smallest_fix(broken: list[str], fixed: list[str], valid=parses, exhaustive: int = 12) -> list[str]:
    """Broken tokens with the fewest of the fix's edits that make them valid; the first such set in text order.

    Patches longer than ``exhaustive`` are thinned one edit at a time instead, until no edit can be spared."""
    patch = alignment(broken, fixed)
    if len(patch) <= exhaustive:
        tries = (_applied(broken, c) for n in range(len(patch) + 1) for c in combinations(patch, n))
        return next(filter(valid, tries), fixed)
    i = 0
    while i < len(patch):
        fewer = patch[:i] + patch[i + 1 :]
        if valid(_applied(broken, fewer)):
            patch, i = fewer, 0
        else:
            i += 1
    return _applied(broken, patch)


def minimised(broken: Column, fixed: Column) -> Column:
    """Smallest part of a Python fix that parses, over token arrays; null for a null side."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else smallest_fix(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(broken, fixed)
