"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from corvane.llm import bagminhash, bpe_automaton, exact_dedup, language_id, line_dedup, ppm_scoring, quality_rules, source_mixing, substring_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_ppm_scoring": ppm_scoring.op3_ppm_scoring,
    "op4_bpe_automaton": bpe_automaton.op4_bpe_automaton,
    "op5_bagminhash": bagminhash.op5_bagminhash,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op6_source_mixing": source_mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
