"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    minhash_dedup,
    sentencepiece_codec,
    suffix_dedup,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
        "op7_minhash": minhash_dedup.op7_minhash,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op3_url_filter": url_filter.OP3_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op7_minhash": minhash_dedup.OP7_SQL,
    }
