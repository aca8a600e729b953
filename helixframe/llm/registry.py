"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import class_lm, fuzzy_hash, language_id, ngram_join, packing, prefix_bpe, quality, substring_dedup, token_counts, training_order

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_fingerprints": fuzzy_hash.op2_fingerprints,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_language_id": language_id.op4_language_id,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_training_order": training_order.op6_training_order,
    "op7_byte_bpe": prefix_bpe.op7_byte_bpe,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES = {"op1_ngram_jaccard_join": ngram_join.OP1_SQL, "op8_substring_dedup": substring_dedup.OP8_SQL, "op9_quality_rules": quality.OP9_SQL}
