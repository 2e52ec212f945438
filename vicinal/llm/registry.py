"""Queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from vicinal.llm import bpe, exact_dedup, language_id, line_dedup, merkle, mixing, pii, repeats, simhash, warc

QUERIES = {
    "op10_repeats": repeats.op10_repeats,
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op5_pii": pii.op5_pii,
    "op8_warc": warc.op8_warc,
    "op3_merkle": merkle.op3_merkle,
    "op2_mixing": mixing.op2_mixing,
    "op6_simhash": simhash.op6_simhash,
    "op4_language_id": language_id.op4_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op9_bpe": bpe.op9_bpe,
    # parts of op3, op5 and op8 that SQL can check
    "merkle_edited_texts": merkle.merkle_edited_texts,
    "pii_base_counts": pii.pii_base_counts,
    "warc_payloads": warc.warc_payloads,
}

ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_repeats": repeats.OP10_SQL,
    "merkle_edited_texts": merkle.EDITED_SQL,
    "pii_base_counts": pii.BASE_COUNTS_SQL,
    "warc_payloads": warc.PAYLOADS_SQL,
}
