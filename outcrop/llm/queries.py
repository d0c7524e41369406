"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import conversation_trie, decontaminate, html_extract, jaccard_join, language_id, license_scan, mixing, pii, quality_classifier, quality_rules, secret_scan, sharding, vector_codes

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_quality_rules": quality_rules.query,
    "op3_secret_scan": secret_scan.query,
    "op4_pii": pii.query,
    "op5_source_mix": mixing.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_decontaminate": decontaminate.query,
    "op9_html_extract": html_extract.query,
    "op10_sharding": sharding.query,
    "op11_language_id": language_id.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_vector_codes": vector_codes.query,
    "quality_ablations": quality_rules.ablation_query,
}
ORACLES = {
    "op1_license_scan": license_scan.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op5_source_mix": mixing.SQL,
    "quality_ablations": quality_rules.ABLATION_SQL,
}
