"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import digest, language, lines, minhash, mixing, neighbours, packing, passages, private, quality

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_pii": private.op5_pii,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_language_id": language.op7_language_id,
    "op8_document_fingerprints": digest.op8_document_fingerprints,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op1_minhash_near_dedup": minhash.ORACLE, "op4_line_dedup": lines.ORACLE}
