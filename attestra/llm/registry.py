"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dup, fill_middle, merkle, mixing, near_dup, packing, privacy, quality_model, quality_rules, suffix_dedup, token_files, tool_calls, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_dup.op1_near_duplicates,
    "op2_exact_duplicates": exact_dup.op2_exact_duplicates,
    "op3_token_files": token_files.op3_token_files,
    "op4_personal_data": privacy.op4_personal_data,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_tool_calls": tool_calls.op9_tool_calls,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": near_dup.OP1_SQL,
    "op2_exact_duplicates": exact_dup.OP2_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_tool_calls": tool_calls.OP9_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_fill_in_middle": fill_middle.OP13_SQL,
}
