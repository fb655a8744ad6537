"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pawgrid.llm import (
    op1_toxicity,
    op2_fingerprints,
    op3_source_mix,
    op4_exact_topk,
    op5_ngram_join,
    op6_token_counts,
    op7_secret_scan,
    op8_best_fit_packing,
    op9_language_id,
    op10_lm_scoring,
    op11_token_alignment,
    op12_conversation_trie,
    op13_license_scan,
)

_MODULES = [op1_toxicity, op2_fingerprints, op3_source_mix, op4_exact_topk, op5_ngram_join, op6_token_counts, op7_secret_scan, op8_best_fit_packing,
            op9_language_id, op10_lm_scoring, op11_token_alignment, op12_conversation_trie, op13_license_scan]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
