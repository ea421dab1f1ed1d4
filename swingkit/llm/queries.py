"""The queries of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: module that defines it, and its SQL as ``ORACLE_SQL`` where SQL can express it.
MODULES = {
    "op1_ring_sharding": "sharding",
    "op2_ppm_language": "language",
    "op3_simhash_bktree": "simhash",
    "op4_nbsvm_quality": "quality",
    "op5_line_block_text": "html",
    "op6_warc_chunks": "warc",
    "op7_nnls_packing": "packing",
    "op8_ngram_ratio_rules": "rules",
    "op9_block_max_topk": "topk",
    "op10_bpe_round_trip": "bpe",
    "op11_diagram_audit": "audit",
    "op12_relational_chat": "chat",
    "op13_interval_search": "search",
}


def _lazy(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"swingkit.llm.{MODULES[name]}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"swingkit.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
