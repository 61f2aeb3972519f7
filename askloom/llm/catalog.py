"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, exact_dedup, exact_topk, fill_in_middle, license_scan, mixing, near_dup, packing, periodic_runs, quality, sharding, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_mix_sources": mixing.query,
    "op3_exact_topk": exact_topk.query,
    "op4_license_scan": license_scan.query,
    "op5_quality_classifier": quality.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_best_fit_packing": packing.query,
    "op9_near_dedup": near_dup.query,
    "op10_min_cost_resharding": sharding.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_decontamination": decontamination.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op3_exact_topk": exact_topk.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op13_decontamination": decontamination.SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
