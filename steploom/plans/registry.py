"""Registry of the engine's own queries, gathered from their modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_text", "q_labels", "q_search", "q_tree", "q_training", "q_sources", "q_loops")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        found |= import_module(f"steploom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"steploom.plans.{name}").SQL
    return found
