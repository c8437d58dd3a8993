"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from strata.llm import bpe, chat, decontaminate, langid, lexical, lines, merkle, mixing, nearjoin, quality, secrets, suffixes, topk

QUERIES = {
    "op1_exact_topk": topk.op1,
    "op2_language_id": langid.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_chat_formatting": chat.op4,
    "op5_suffix_array_dedup": suffixes.op5,
    "op6_line_dedup": lines.op6,
    "op7_quality": quality.op7,
    "op8_secret_scans": secrets.op8,
    "op9_ngram_jaccard_join": nearjoin.op9,
    "op10_mixing": mixing.op10,
    "op11_byte_bpe": bpe.op11,
    "op12_lexical_search": lexical.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLE_SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_suffix_array_dedup": suffixes.OP5_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op9_ngram_jaccard_join": nearjoin.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
