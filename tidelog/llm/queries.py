"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, fingerprints, jaccard, langid, line_dedup, packing, secret_scan, token_io, topk

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_secret_scans": secret_scan.op6_secret_scans,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_chat_formatting": chat_format.op8_chat_formatting,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_token_id_output": token_io.op10_token_id_output,
}
ORACLE = {
    "op3_line_dedup": line_dedup.SQL,
    "op6_secret_scans": secret_scan.SQL,
    "op8_chat_formatting": chat_format.SQL,
    "op9_exact_topk": topk.SQL,
}
