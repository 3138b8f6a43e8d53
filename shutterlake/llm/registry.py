"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, fingerprints, importance, language, licenses, mixing, near_dups, passages, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality_resampling": importance.op3_quality_resampling,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_near_duplicates": near_dups.op8_near_duplicates,
    "op9_language_id": language.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_license_scan": licenses.OP2_SQL,
    "op4_repeated_passages": passages.OP4_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_near_duplicates": near_dups.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
