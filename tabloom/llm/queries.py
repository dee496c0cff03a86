"""The corpus queries and their SQL, added to the entry module when this subpackage is present."""

from __future__ import annotations

from tabloom.llm import alignment, decontam, importance, jaccard_join, langid, license_scan, line_dedup, packing, parsing, quality_rules, sharding, token_codes, url_rules

QUERIES = {
    "op1_url_rules": url_rules.op1_url_rules,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_codes": token_codes.op8_token_codes,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_fingerprints": parsing.op13_fingerprints,
}

ORACLE_SQL = {
    "op1_url_rules": url_rules.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op10_decontamination": decontam.SQL,
    "op11_importance_resampling": importance.SQL,
}
