"""Registered queries of the training-data operators. The pipeline over them is corpus_pipeline.py."""

from lexatlas.llm import id_files, language_id, merkle_manifest, near_dedup, packing, periodic_runs, pii_scan, quality_classifier, quality_rules, secret_scan, sentence_pieces, sql, suffix_dedup, topk_index

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_sentence_pieces": sentence_pieces.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_pii_scan": pii_scan.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_quality_classifier": quality_classifier.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_id_files": id_files.op9,
    "op10_topk_index": topk_index.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_language_id": language_id.op12,
    "op13_merkle_manifest": merkle_manifest.op13,
}
#: Those that SQL can express. The others need a tokenizer, a trained model or corpus-wide statistics of hashes.
ORACLE_SQL = {
    "op1_minhash_near_dedup": sql.NEAR_DEDUP,
    "op6_suffix_dedup": sql.SUFFIX_DEDUP,
    "op10_topk_index": sql.TOPK,
    "op11_periodic_runs": sql.periodic_runs(),
    "op13_merkle_manifest": sql.MERKLE,
}
