"""Lexers and subword tokenizers."""

from __future__ import annotations

import io
import keyword
import textwrap
import tokenize
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .coding import python_token_id
from .text import RESERVED

# Comments, strings, numbers, names, white space, then operators of one character.
LEXEME = r"""//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[0-9]+(?:\.[0-9]+)?|[A-Za-z_$][A-Za-z0-9_$]*|[ \t\r\n]+|(?s:.)"""


# The same for Kotlin: raw strings, backticked names, labels.
KOTLIN_LEXEME = r"""//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|"{3}(?s:.*?)"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]+`|[0-9]+(?:\.[0-9]+)?[fFLuU]*|@?[A-Za-z_][A-Za-z0-9_]*@?|[ \t\r\n]+|(?s:.)"""


def kotlin_lexemes(text: Column) -> Column:
    """Lexemes of Kotlin source; together they are the text."""
    return F.regexp_extract_all(text, F.lit(KOTLIN_LEXEME), 0)


def lexemes(text: Column) -> Column:
    """Lexemes of Java-like source; together they are the text."""
    return F.regexp_extract_all(text, F.lit(LEXEME), 0)


def lexeme_kind(t: Column) -> Column:
    """comment, string, number, keyword, name, space or operator."""
    return (F.when(F.substring(t, 1, 2).isin("//", "/*"), "comment").when(F.substring(t, 1, 1).isin('"', "'") & (F.length(t) > 1), "string")
            .when(t.rlike("^[0-9]"), "number").when(t.isin(*RESERVED), "keyword").when(t.rlike("^[A-Za-z_$]"), "name").when(t.rlike(r"^[ \t\r\n]"), "space").otherwise("operator"))


def coarsened(tokens: Column) -> Column:
    """Reserved words and operators stay, names become w, numbers 0, strings and comments lose their content, space goes."""
    kind = lexeme_kind
    put = lambda t: F.when(kind(t) == "name", "w").when(kind(t) == "number", "0").when(kind(t) == "string", '""').when(kind(t) == "comment", "//").otherwise(t)
    return F.transform(F.filter(tokens, lambda t: kind(t) != "space"), put)


# Placeholders of coarse tokens and the kinds they stand for.
PLACEHOLDERS = {"w": "name", "0": "number", '""': "string", "//": "comment"}


def uncoarsened(coarse: Column, tokens: Column) -> Column:
    """Coarse tokens with the names, numbers, strings and comments of the originals put back in their order.

    Coarse tokens may have been edited: a placeholder beyond the originals stays a placeholder."""
    def put_back(coarse: list[str], tokens: list[str], kinds: list[str]) -> list[str]:
        pools = {k: iter([t for t, own in zip(tokens, kinds) if own == k]) for k in PLACEHOLDERS.values()}
        return [next(pools[PLACEHOLDERS[c]], c) if c in PLACEHOLDERS else c for c in coarse]

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else put_back(x, y, k) for x, y, k in zip(a.to_pylist(), b.to_pylist(), c.to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(coarse, tokens, F.transform(tokens, lambda t: lexeme_kind(t)))


def _python(source: pa.Array) -> pa.Array:
    out = []
    for s in source.to_pylist():
        found = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(s or "").readline):
                found.append({"kind": tokenize.tok_name[t.type], "text": t.string})
        except (tokenize.TokenError, SyntaxError):
            found.append({"kind": "ERRORTOKEN", "text": ""})  # what follows can't be read
        out.append(None if s is None else found)
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))


def python_tokens(source: Column) -> Column:
    """array<struct<kind, text>> of Python source; unreadable source ends with an ERRORTOKEN; null stays null."""
    return F.arrow_udf(_python, "array<struct<kind:string,text:string>>")(source)


def python_kinds(tokens: Column) -> Column:
    """Kinds as a grammar's terminals: names, numbers and strings by kind, keywords and operators as themselves; blank lines and comments go."""
    kept = F.filter(tokens, lambda t: ~t["kind"].isin("NL", "COMMENT", "ENCODING", "ENDMARKER"))
    reserved = F.array(*map(F.lit, keyword.kwlist))
    return F.transform(kept, lambda t: F.when((t["kind"] == "OP") | (t["kind"] == "NAME") & F.array_contains(reserved, t["text"]), t["text"]).otherwise(t["kind"]))


def python_type_ids(tokens: Column) -> Column:
    """The tokenizer module's numbers of the tokens' kinds."""
    return F.transform(tokens, lambda t: python_token_id(t["kind"]))


def rendered_python(kinds: Column) -> Column:
    """Source for a sequence of kinds: fresh names, numbers and strings; indents and line ends where the kinds say so."""
    def render(kinds: list[str]) -> str:
        out, depth, begin, names = [], 0, True, 0
        for k in kinds:
            if k in ("INDENT", "DEDENT"):
                depth += 1 if k == "INDENT" else -1
                continue
            if k == "NEWLINE":
                out.append("\n")
                begin = True
                continue
            if begin:
                out.append("    " * max(depth, 0))
            elif out:
                out.append(" ")
            begin = False
            if k == "NAME":
                names += 1
            out.append({"NAME": f"a{names}", "NUMBER": "1", "STRING": "'s'"}.get(k, k))
        return "".join(out)

    return F.arrow_udf(lambda batch: pa.array([None if t is None else render(t) for t in batch.to_pylist()], pa.string()), "string")(kinds)


def with_newline(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def cleaned(text: Column) -> Column:
    """Without null, replacement and control characters; all white space becomes a space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00\x{FFFD}]|(?![\t\n\r])[\p{Cc}\p{Cf}]", ""), r"[\t\n\r]|\p{Zs}", " ")


def basic_tokens(text: Column) -> Column:
    """Lower-cased words; every punctuation mark and CJK character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4E00}-\x{9FA5}]|[^\s\p{P}\p{S}\x{4E00}-\x{9FA5}]+|[\p{P}\p{S}]"), 0)


def vocabulary_ids(tokens: Column, vocabulary: list[str], unknown: str = "[UNK]") -> Column:
    """Places of the tokens in the vocabulary; a token outside it has the place of the unknown one."""
    table = F.create_map(*[x for i, t in enumerate(vocabulary) for x in (F.lit(t), F.lit(i))])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), F.lit(vocabulary.index(unknown))))


def vocabulary_tokens(ids: Column, vocabulary: list[str]) -> Column:
    """The inverse; null for an id outside the vocabulary."""
    return F.transform(ids, lambda i: F.get(F.array(*map(F.lit, vocabulary)), i))


def wordpieces(word: Column, vocabulary: frozenset[str], unknown: str = "[UNK]", longest_word: int = 200) -> Column:
    """Longest pieces first, later ones marked ##; a word that can't be covered, or is too long, is unknown.  Apply to distinct words."""
    longest = max(map(len, vocabulary), default=0)

    def split(w: str) -> list[str]:
        found, at = [], 0
        if len(w) > longest_word:
            return [unknown]
        while at < len(w):
            mark = "##" if at else ""
            end = next((e for e in range(min(len(w), at + longest), at, -1) if mark + w[at:e] in vocabulary), 0)
            if not end:
                return [unknown]
            found.append(mark + w[at:end])
            at = end
        return found

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if w is None else split(w) for w in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(word)


def _methods(source: pa.Array) -> pa.Array:
    starts = ("fun ", "def ", "function ", "public ", "private ", "protected ", "static ")
    out = []
    for s in source.to_pylist():
        found, current, depth = [], None, 0
        for line in (s or "").split("\n"):
            if current is None and line.lstrip().startswith(starts) and "(" in line:
                current, depth = [], 0
            if current is not None:
                current.append(line)
                depth += line.count("{") - line.count("}")
                if depth <= 0 and any("}" in x for x in current):
                    found.append("\n".join(current))
                    current = None
        out.append(None if s is None else found)
    return pa.array(out, pa.list_(pa.string()))


def methods(source: Column, parser: Callable[[str], list[str]] | None = None) -> Column:
    """Methods in braces: from a line that declares one to the line that closes its last brace; unclosed ones are dropped.

    A parser of one's own takes a text and gives its methods; a text that it fails on has none (null)."""
    if parser is None:
        return F.arrow_udf(_methods, "array<string>")(source)

    def run(batch: pa.Array) -> pa.Array:
        out = []
        for s in batch.to_pylist():
            try:
                out.append(None if s is None else list(parser(s)))
            except Exception:  # noqa: BLE001 - whatever the caller's parser raises, the text is dropped
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(source)


# What begins a method's line, and what rules a line out.
METHOD_WORDS, NOT_METHOD_WORDS = ("public ", "private ", "void ", "static ", "fun ", "/**"), ("class",)


def _bracket_sum(line: str) -> int:
    return sum((c in "({[") - (c in ")}]") for c in line)


def sliced_methods(text: str) -> list[str]:
    """Methods by bracket counting: a line that opens one starts it, lines follow while brackets are open and, once they are
    closed, until a blank line; the common indent goes; slices without ( and { are dropped."""
    found: list[list[str]] = []
    open_brackets: int | None = None
    for line in text.splitlines():
        if open_brackets is None or open_brackets < 0:
            starts = any(w in line for w in METHOD_WORDS) and not any(w in line for w in NOT_METHOD_WORDS) and "(" in line
            if starts:
                found.append([line])
            open_brackets = _bracket_sum(line) if starts else None
        elif open_brackets == 0 and not line.strip():
            open_brackets = None
        else:
            found[-1].append(line)
            open_brackets += _bracket_sum(line) if open_brackets else 0
    whole = [textwrap.dedent("\n".join(m)).strip("\n") for m in found]
    return [m for m in whole if "(" in m and "{" in m]
