"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, caps, chat, html, linededup, mixing, rollups, simhash, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_ann": ann.op3_ann,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_rollups": rollups.op5_token_rollups,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html": html.op7_html,
    "op8_chat": chat.op8_chat,
    "op9_caps": caps.op9_caps,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op5_token_rollups": rollups.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
