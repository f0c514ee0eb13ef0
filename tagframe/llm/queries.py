"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from tagframe.llm import (best_fit, chosen_path, exact_dedup, forced_bpe, hard_negatives, huffman_ids, language_spans,
                           license_rules, piece_lattice, quality_cnn, repetition, source_divergence, toxicity)

QUERIES = {
    "op1_huffman_ids": huffman_ids.op1_huffman_ids,
    "op2_noisy_channel": toxicity.op2_noisy_channel,
    "op3_best_fit_packing": best_fit.op3_best_fit_packing,
    "op4_piece_lattice": piece_lattice.op4_piece_lattice,
    "op5_suffix_repetition": repetition.op5_suffix_repetition,
    "op6_language_spans": language_spans.op6_language_spans,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_byte_cnn": quality_cnn.op8_byte_cnn,
    "op9_chosen_path": chosen_path.op9_chosen_path,
    "op10_license_rules": license_rules.op10_license_rules,
    "op11_slot_negatives": hard_negatives.op11_slot_negatives,
    "op12_cube_divergence": source_divergence.op12_cube_divergence,
    "op13_forced_boundary": forced_bpe.op13_forced_boundary,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_slot_negatives": hard_negatives.OP11_SQL,
    "op12_cube_divergence": source_divergence.OP12_SQL,
}
