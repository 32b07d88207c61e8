"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, dedup, jaccard, language, lattice, licences, lm, merkle, packing, periodic, repeats, topk, toxicity

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_exact_dedup": dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_licences": licences.op4_licences,
    "op5_repeats": repeats.op5_repeats,
    "op6_packing": packing.op6_packing,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_lm_score": lm.op8_lm_score,
    "op9_language": language.op9_language,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_near_embeddings": lattice.op12_near_embeddings,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL = {"op1_top_k": topk.ORACLE, "op2_exact_dedup": dedup.ORACLE, "op4_licences": licences.ORACLE, "op13_merkle": merkle.ORACLE}
