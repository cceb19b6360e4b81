"""The queries of this subpackage by name, and their DuckDB twins where SQL expresses them."""

from __future__ import annotations

from . import fingerprints, html_extract, mixing, near_dedup, quality_classifier, quality_rules, secret_scans, sentencepiece_codec, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_secret_scans": secret_scans.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
}
