"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import centroids, decontaminate, filter_audit, langid, lm_scoring, mixing, packing, pii, quality_lm, quality_rules, simhash, token_counts, url_filter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_kneser_ney_quality": quality_lm.op2_kneser_ney_quality,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_weak_pii": pii.op4_weak_pii,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_simhash": simhash.op6_simhash,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_centroids": centroids.op12_centroids,
    "op13_fair_mix": mixing.op13_fair_mix,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op8_lm_scoring": lm_scoring.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_fair_mix": mixing.ORACLE,
}
