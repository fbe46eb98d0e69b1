"""The registered queries of the operators of this subpackage, and their SQL."""

from quillmark.llm import decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, prefix_tokens, quality_classifier, quality_rules, url_templates

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_nnls_packing": packing.query,
    "op4_minhash_near_dedup": near_dedup.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_lm_scoring": lm_scoring.query,
    "op7_url_templates": url_templates.query,
    "op8_language_id": language_id.query,
    "op9_token_counts": prefix_tokens.query,
    "op10_benchmark_decontamination": decontamination.query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_minhash_near_dedup": near_dedup.SQL,
    "op10_benchmark_decontamination": decontamination.SQL,
}
