"""Registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from quietkey.llm import alignment, decontamination, language_id, mixing, pieces, pii, prefix_trie, quality, secret_scan, simhash, token_counts, toxicity, url_filters

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_pieces": pieces.op12_pieces,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op3_url_filters": url_filters.SQL,
    "op5_quality": quality.SQL,
}
