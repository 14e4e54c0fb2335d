"""The training-data queries, gathered from their modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_topn", "q_truncation", "q_overlap", "q_consensus", "q_pairs", "q_splitting", "q_bpe", "q_mixing", "q_spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        found |= import_module(f"steploom.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"steploom.llm.{name}").SQL
    return found
