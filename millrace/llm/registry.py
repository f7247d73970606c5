"""Queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from millrace.llm import bpe, fingerprints, jaccard_join, language_id, lm_scores, packing, quality_rules, sharding, token_files, toxicity
from millrace.llm.oracles import ORACLES


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_sharding": sharding.op2_sharding,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_packing": packing.op6_packing,
        "op7_token_files": token_files.op7_token_files,
        "op8_bpe": bpe.op8_bpe,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_lm_scores": lm_scores.op10_lm_scores,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
