"""The registered queries of this subpackage and their SQL."""

from cloudinv.llm import centroids, decontamination, line_dedup, lm, mixing, negatives, packing, quality, repeats, simhash
from cloudinv.llm import token_counts, topk, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality_votes": quality.op2_quality_votes,
    "op3_simhash_neardup": simhash.op3_simhash_neardup,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_lm_score": lm.op6_lm_score,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_ptolemaic_clusters": centroids.op13_ptolemaic_clusters,
}

ORACLE = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_ptolemaic_clusters": centroids.ORACLE,
}
