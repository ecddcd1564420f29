"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, huffman, language, near_dups, neighbours, packing, suffixes, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_id_output": huffman.query,
        "op2_minhash_near_dedup": near_dups.query,
        "op3_toxicity": toxicity.query,
        "op4_chat_formatting": chat.query,
        "op5_suffix_array_dedup": suffixes.query,
        "op6_nearest_neighbours": neighbours.query,
        "op7_packing": packing.query,
        "op8_benchmark_decontamination": decontaminate.query,
        "op9_language_id": language.query,
        "op10_token_counts": token_counts.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": near_dups.SQL, "op4_chat_formatting": chat.SQL}
