"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmesh.llm import jaccard_join, language_id, lm_scoring, packing, piece_codec, quality_classifier, quality_rules, token_counts, topk_search, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_packing": packing.op8_packing,
        "op9_piece_codec": piece_codec.op9_piece_codec,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.oracle_sql(),
        "op4_topk_search": topk_search.ORACLE,
        "op7_jaccard_join": jaccard_join.ORACLE,
    }
