"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from bucketloom.llm import exact_dedup, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, secrets, sharding

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLES = {
    "op2_license_scan": licenses.ORACLE_OP2,
    "op5_line_dedup": line_dedup.ORACLE_OP5,
    "op7_exact_dedup": exact_dedup.ORACLE_OP7,
    "op8_secret_scan": secrets.ORACLE_OP8,
    "op9_minhash_near_dedup": near_dedup.ORACLE_OP9,
}
