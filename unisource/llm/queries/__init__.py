"""The registered queries of the corpus operators and their SQL."""

from unisource.llm.queries.models import (
    op1_jaccard_join, op2_toxicity, op3_token_counts, op4_language_id, op6_lm_scores, op7_packing, op9_substring_dedup,
    op11_periodic_runs, op12_collocations, op13_simhash_dedup,
)
from unisource.llm.queries.native import (
    OP5_SQL, OP8_SQL, OP10_SQL, op5_quality_rules, op8_secret_scans, op10_decontamination,
)

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scores": op6_lm_scores,
    "op7_packing": op7_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_simhash_dedup": op13_simhash_dedup,
}
ORACLES = {"op8_secret_scans": OP8_SQL, "op10_decontamination": OP10_SQL}

__all__ = ["ORACLES", "OP5_SQL", "QUERIES"]
