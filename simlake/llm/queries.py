"""The queries of the subpackage and their SQL, for the entry module."""

from __future__ import annotations

from simlake.llm import bpe, html_extract, licenses, media, mixing, near_dup, pii, token_counts, toxicity, vector_dedup

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_bpe": bpe.op3_bpe,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licenses": licenses.op7_licenses,
    "op8_near_dedup": near_dup.op8_near_dedup,
    "op9_media": media.op9_media,
    "op10_vector_dedup": vector_dedup.op10_vector_dedup,
}
ORACLE_SQL = {**mixing.ORACLE, "op7_licenses": licenses.oracle(), **near_dup.ORACLE, **vector_dedup.ORACLE}
