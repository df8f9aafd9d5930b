"""Rewriting queries: one row per changed text, with the digest of its variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewrites as R
from ..sources.corpus import table


def _turns(spark, sf, variant):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", R.seed("conv_id", "turn").alias("seed"))
    t = t.select("conv_id", "turn", "text", F.explode(F.array(variant(F.col("text"), F.col("seed")))).alias("new"))  # rewritten once
    return t.where("new <> text").select("conv_id", "turn", F.md5("new").alias("variant_md5"))


def _docs(spark, sf, variant):
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(variant(F.col("text")))).alias("new"))
    return d.where("new <> text").select("doc_id", F.md5("new").alias("variant_md5"))


def sct_mutate(spark, sf):
    return _turns(spark, sf, R.mutate)


def sct_shuffle_lines(spark, sf):
    return _turns(spark, sf, R.shuffle_lines)


def sct_swap_lines(spark, sf):
    return _docs(spark, sf, R.swap_independent_lines)


def sct_reverse_arguments(spark, sf):
    return _docs(spark, sf, R.reverse_arguments)


def sct_loop_bounds(spark, sf):
    return _docs(spark, sf, R.shift_loop_bounds)


def sct_add_logging(spark, sf):
    return _turns(spark, sf, lambda t, s: R.add_logging(t, s, "."))


def mask_window(spark, sf):
    return _turns(spark, sf, R.mask_window)


_DRAW = "(s + %s) * 48271 %% 2147483647 %% %s"
_TURNS = "t AS (SELECT conv_id, turn, text, CAST('0x' || substr(md5(conv_id || '-' || turn), 1, 7) AS BIGINT) AS s FROM conversations)"
_LINES = "string_split(text, chr(10))"
_OUT = "SELECT conv_id, turn, md5(v) AS variant_md5 FROM v WHERE v <> text"
_DOC = "SELECT doc_id, md5(v) AS variant_md5 FROM v WHERE v <> text"

QUERIES = {f.__name__: f for f in (sct_mutate, sct_shuffle_lines, sct_swap_lines, sct_reverse_arguments, sct_loop_bounds, sct_add_logging, mask_window)}
ORACLE_SQL = {
    "sct_mutate": rf"""WITH {_TURNS}, v AS (SELECT *, array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c, i:
        CASE WHEN regexp_matches(c, '\S') AND {_DRAW % ('i - 1', 10)} < 3 THEN chr(CAST(97 + {_DRAW % ('i', 26)} AS INTEGER)) ELSE c END), '') AS v FROM t) {_OUT}""",
    "sct_shuffle_lines": f"""WITH {_TURNS}, v AS (SELECT *, array_to_string(list_transform(list_sort(list_transform({_LINES}, lambda x, i:
        {{'k': {_DRAW % ('(i - 1) * 7919', 1000003)}, 'i': i, 'x': x}})), lambda y: y.x), chr(10)) AS v FROM t) {_OUT}""",
    "sct_swap_lines": rf"""WITH l AS (SELECT *, {_LINES} AS l FROM documents),
        x AS (SELECT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS x, unnest(list_transform(l, lambda y, j: l[CASE WHEN j % 2 = 1 THEN j + 1 ELSE j - 1 END])) AS o FROM l),
        v AS (SELECT doc_id, text, string_agg(CASE WHEN length(regexp_extract(x, '^[ \t]*')) = length(regexp_extract(o, '^[ \t]*'))
          AND NOT list_has_any(regexp_extract_all(x, '[A-Za-z]+'), regexp_extract_all(o, '[A-Za-z]+')) THEN o ELSE x END, chr(10) ORDER BY i) AS v FROM x GROUP BY doc_id, text) {_DOC}""",
    "sct_reverse_arguments": rf"""WITH a AS (SELECT *, regexp_extract(text, '\(([^()]*, [^()]*)\)', 1) AS a FROM documents),
        v AS (SELECT *, replace(text, '(' || a || ')', '(' || array_to_string(list_reverse(string_split(a, ', ')), ', ') || ')') AS v FROM a WHERE a <> '') {_DOC}""",
    "sct_loop_bounds": rf"""WITH v AS (SELECT *, array_to_string(list_transform({_LINES}, lambda x: CASE WHEN regexp_matches(x, '\b(for|while)\b') AND regexp_matches(x, '^(.*)([0-9])([^0-9]*)$')
        THEN regexp_extract(x, '^(.*)([0-9])([^0-9]*)$', 1) || (CAST(regexp_extract(x, '^(.*)([0-9])([^0-9]*)$', 2) AS INTEGER) + 1 + length(x) % 3) || regexp_extract(x, '^(.*)([0-9])([^0-9]*)$', 3) ELSE x END), chr(10)) AS v FROM documents) {_DOC}""",
    "sct_add_logging": f"""WITH {_TURNS}, v AS (SELECT *, array_to_string(list_transform({_LINES}, lambda x, i:
        CASE WHEN ends_with(x, '.') AND {_DRAW % ('i - 1', 10)} < 3 THEN x || chr(10) || 'println("line ' || (i - 1) || '");' ELSE x END), chr(10)) AS v FROM t) {_OUT}""",
    "mask_window": f"""WITH {_TURNS}, a AS (SELECT *, {_DRAW % (0, 1 << 30)} % greatest(length(text) - 2, 1) AS a FROM t),
        v AS (SELECT *, substr(text, 1, a) || '<mask>' || substr(text, a + 4) AS v FROM a) {_OUT}""",
}
