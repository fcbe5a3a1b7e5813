"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import blob_ledger, column_bwt, countmin_spans, decision_list, delta_lloyd, ecoc_langid, es_mixing, exact_dedup, importance_resampling, oph_minhash, prefix_bpe, simhash_cover, zstd_quality

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_prefix_bpe": prefix_bpe.op2_prefix_bpe,
    "op3_ecoc_langid": ecoc_langid.op3_ecoc_langid,
    "op4_decision_list": decision_list.op4_decision_list,
    "op5_simhash_cover": simhash_cover.op5_simhash_cover,
    "op6_zstd_quality": zstd_quality.op6_zstd_quality,
    "op7_countmin_spans": countmin_spans.op7_countmin_spans,
    "op8_es_mixing": es_mixing.op8_es_mixing,
    "op9_blob_ledger": blob_ledger.op9_blob_ledger,
    "op10_column_bwt": column_bwt.op10_column_bwt,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op12_delta_lloyd": delta_lloyd.op12_delta_lloyd,
    "op13_oph_minhash": oph_minhash.op13_oph_minhash,
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op8_es_mixing": es_mixing.SQL,
    "op9_blob_ledger": blob_ledger.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
    "op12_delta_lloyd": delta_lloyd.SQL,
    "op13_oph_minhash": oph_minhash.SQL,
}
