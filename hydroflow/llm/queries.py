"""Registered queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from . import bpe, embed_dedup, exact_dedup, html_extract, langid, line_dedup, lm_scoring, mixing, prefix_trie, quality, simhash, substring, turn_repair

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1,
    "op2_substring_dedup": substring.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_mix_sources": mixing.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_embedding_near_dedup": embed_dedup.op6,
    "op7_language_id": langid.op7,
    "op8_html_extraction": html_extract.op8,
    "op9_bpe": bpe.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_quality": quality.op11,
    "op12_turn_repair": turn_repair.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_mix_sources": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_turn_repair": turn_repair.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
