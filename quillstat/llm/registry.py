"""Queries of the training-data operators: one opN_<name> each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstat.llm import byte_bpe, decontaminate, language_id, line_dedup, merkle, pii, simhash, suffix_tree, token_store, tool_calls, topk, toxicity, vector_codes
from quillstat.shipping import ship

_MODULES = {
    "op1_token_store": token_store,
    "op2_decontaminate": decontaminate,
    "op3_top_k": topk,
    "op4_suffix_tree": suffix_tree,
    "op5_tool_calls": tool_calls,
    "op6_pii": pii,
    "op7_language_id": language_id,
    "op8_byte_bpe": byte_bpe,
    "op9_simhash": simhash,
    "op10_line_dedup": line_dedup,
    "op11_vector_codes": vector_codes,
    "op12_merkle": merkle,
    "op13_toxicity": toxicity,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, m=m: m.query(ship(spark), sf_dir) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if hasattr(m, "SQL")}
