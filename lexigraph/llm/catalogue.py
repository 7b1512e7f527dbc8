"""The corpus queries and their SQL, for the driver's registry."""

from __future__ import annotations

import corpus_pipeline
from lexigraph.llm import audit, contamination, html, language, lines, lm_score, mixing, near_dup, quality, substrings, toxicity, urls, whitening

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_decontamination": contamination.op2_decontamination,
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_url_filters": urls.op6_url_filters,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language.op8_language_id,
    "op9_near_dedup": near_dup.op9_near_dedup,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_substring_dedup": substrings.op11_substring_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_filter_audit": audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_line_dedup": lines.OP1_SQL,
    "op2_decontamination": contamination.OP2_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_substring_dedup": substrings.OP11_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
