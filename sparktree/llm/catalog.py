"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from . import byte_pairs, decontamination, importance_resampling, language_id, multi_index, packing, periodic_runs, prefix_trie, simhash, substring_dedup, toxicity, url_filters, warc

QUERIES = {
    "op9_nearest_neighbours": multi_index.op9_nearest_neighbours,
    "op1_quality_classifier": importance_resampling.op1_quality_classifier,
    "op5_language_id": language_id.op5_language_id,
    "op10_warc": warc.op10_warc,
    "op2_url_filters": url_filters.op2_url_filters,
    "op8_decontamination": decontamination.op8_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op6_packing": packing.op6_packing,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op11_byte_level_bpe": byte_pairs.op11_byte_level_bpe,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_conversation_trie": prefix_trie.op13_conversation_trie,
}
ORACLE_SQL = {
    "op10_warc": warc.ORACLE_SQL,
    "op2_url_filters": url_filters.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
    "op13_conversation_trie": prefix_trie.ORACLE_SQL,
}
