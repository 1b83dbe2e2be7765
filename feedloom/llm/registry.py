"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from feedloom.llm import bpe_codec, decontaminate, fill_middle, filter_audit, html_text, jaccard_join, license_scan, pieces, quality_model, quality_rules, token_counts, toxicity, warc

QUERIES = {
    "op1_quality_model": quality_model.query,
    "op2_decontaminate": decontaminate.query,
    "op3_html_text": html_text.query,
    "op4_toxicity": toxicity.query,
    "op5_license_scan": license_scan.query,
    "op6_warc": warc.query,
    "op7_token_counts": token_counts.query,
    "op8_quality_rules": quality_rules.query,
    "op9_bpe_codec": bpe_codec.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_filter_audit": filter_audit.query,
    "op12_fill_middle": fill_middle.query,
    "op13_pieces": pieces.query,
}
ORACLE: dict[str, str] = {
    "op5_license_scan": license_scan.oracle(),
    "op6_warc": warc.ORACLE,
    "op8_quality_rules": quality_rules.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
