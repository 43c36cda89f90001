"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from cohortlens.llm import byte_bpe, filter_audit, gam, learned_index, line_crf, lsh_forest, mixing, pivot_index, prefix_trie, suffix_dedup, token_counts, url_filter, wavelet

QUERIES = {
    "op1_line_crf": line_crf.op1_line_crf,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_wavelet": wavelet.op3_wavelet,
    "op4_mixing": mixing.op4_mixing,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_gam": gam.op7_gam,
    "op8_redirects": url_filter.op8_redirects,
    "op9_learned_partitions": learned_index.op9_learned_partitions,
    "op10_lsh_forest": lsh_forest.op10_lsh_forest,
    "op11_pivot_distance": pivot_index.op11_pivot_distance,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "redirects_planted": url_filter.redirects_planted,
    "redirects_chained": url_filter.redirects_chained,
}

#: Where SQL can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {"op8_redirects": url_filter.SQL, "redirects_planted": url_filter.PLANTED_SQL, "redirects_chained": url_filter.CHAINED_SQL, "op4_mixing": mixing.SQL, "op10_lsh_forest": lsh_forest.SQL, "op11_pivot_distance": pivot_index.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_filter_audit": filter_audit.SQL}
