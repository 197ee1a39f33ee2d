"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate, html_text, language, licenses, line_dedup, packing, quality, simhash, substring_dedup, suffix_dedup,
)

QUERIES = {
    "op1_language_id": language.op1,
    "op2_html_extraction": html_text.op2,
    "op3_benchmark_decontamination": decontaminate.op3,
    "op4_suffix_array_dedup": suffix_dedup.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_quality_rules": quality.op9,
    "op10_license_scans": licenses.op10,
}
ORACLE = {
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
}
