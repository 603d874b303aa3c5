"""The registered queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bpe, filter_audit, fingerprints, importance_resampling, lsh_forest, ngram_jaccard_join, packing, pii, quality_classifier, quality_rules, sharding, substring_dedup, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard_join.op1_ngram_jaccard_join,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_pii": pii.op3_pii,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_sharding": sharding.op10_sharding,
    "op11_minhash_near_dedup": lsh_forest.op11_minhash_near_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op9_warc": warc.SQL,
    "op11_minhash_near_dedup": lsh_forest.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_importance_resampling": importance_resampling.SQL,
}
