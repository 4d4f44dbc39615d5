"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import block_max, byte_bpe, centroids, langid, license_scan, near_dup, phrase_index, pii, repetition, site_text, suffix_dedup, token_count, warc_store

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_site_text": site_text.op2_site_text,
    "op3_langid": langid.op3_langid,
    "op4_warc": warc_store.op4_warc,
    "op5_repetition": repetition.op5_repetition,
    "op6_pii": pii.op6_pii,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_decontaminate": phrase_index.op8_decontaminate,
    "op9_near_dup": near_dup.op9_near_dup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_exponion": centroids.op11_exponion,
    "op12_token_count": token_count.op12_token_count,
    "op13_block_max": block_max.op13_block_max,
}

ORACLES = {
    "op4_warc": warc_store.OP4_SQL,
    "op8_decontaminate": phrase_index.OP8_SQL,
    "op9_near_dup": near_dup.OP9_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_exponion": centroids.OP11_SQL,
    "op13_block_max": block_max.OP13_SQL,
}
