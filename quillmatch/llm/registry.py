"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import decontaminate, license_scan, lm_score, packing, quality, simhash_dedup, suffix_dedup, token_counts, token_shards, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_simhash": simhash_dedup.op8_simhash,
    "op9_token_shards": token_shards.op9_token_shards,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: SQL where it can express the whole result; the others are tested against brute force.
ORACLES = {"op2_url_filter": url_filter.ORACLE}
