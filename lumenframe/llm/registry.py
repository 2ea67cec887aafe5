"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query: (module, SQL constant or None)
OPS = {
    "op1_mix_sources": ("mixing", "OP1_SQL"),
    "op2_embedding_near_dup": ("pivots", "OP2_SQL"),
    "op3_language_id": ("language", None),
    "op4_exact_dedup": ("exact", "OP4_SQL"),
    "op5_ppm_scores": ("ppm", None),
    "op6_token_records": ("tokens", None),
    "op7_fuzzy_passages": ("passages", None),
    "op8_hyperminhash_dedup": ("minhash", "OP8_SQL"),
    "op9_toxic_spans": ("toxicity", None),
    "op10_pack_sequences": ("packing", None),
    "op11_line_dedup": ("lines", "OP11_SQL"),
    "op12_periodic_runs": ("periods", "OP12_SQL"),
    "op13_fill_in_middle": ("middle", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"lumenframe.llm.{module}"), name) for name, (module, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lumenframe.llm.{module}"), sql) for name, (module, sql) in OPS.items() if sql}
