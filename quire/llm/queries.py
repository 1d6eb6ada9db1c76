"""The registered queries of this subpackage, and their SQL for the ones that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (decontaminate, hard_negatives, inner_products, langid, lm_score, mixing, neardup, pii, prefix_trie, quality_model, quality_rules,
                       substring, suffixes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_quality_classifier": quality_model.op3,
    "op4_near_duplicates": neardup.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_pii": pii.op6,
    "op7_lm_score": lm_score.op7,
    "op8_substring_dedup": substring.op8,
    "op9_suffix_array_dedup": suffixes.op9,
    "op10_language_id": langid.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_top_k": inner_products.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_near_duplicates": neardup.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_substring_dedup": substring.OP8_SQL,
    "op9_suffix_array_dedup": suffixes.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_top_k": inner_products.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
