"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, mixing, packing, pii, quality, repair, resample, rollup, runs, simhash, substring, topk

QUERIES = {
    "op1_rule_ensemble_quality": quality.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_repair_token_files": repair.op3,
    "op4_pfair_mixing": mixing.op4,
    "op5_greedy_tiling_decontamination": decontaminate.op5,
    "op6_dual_tree_top_k": topk.op6,
    "op7_substring_dedup": substring.op7,
    "op8_language_id": langid.op8,
    "op9_token_rollups": rollup.op9,
    "op10_pii_surrogates": pii.op10,
    "op11_importance_resampling": resample.op11,
    "op12_periodic_runs": runs.op12,
    "op13_karmarkar_karp_packing": packing.op13,
}
ORACLES: dict[str, str] = {"op6_dual_tree_top_k": topk.ORACLE6, "op11_importance_resampling": resample.ORACLE11}
