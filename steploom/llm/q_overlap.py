"""Problem 3: questions of the evaluation splits that occur in training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steploom.llm.overlap import SplitOverlap
from steploom.sources import read_table


def _overlap(spark: SparkSession, sf_dir: str) -> SplitOverlap:
    return SplitOverlap(read_table(spark, sf_dir, "trajectories"), "trajectory_id", "split", "source", "question", "gold_answer")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).pairs("trajectory_id_a", "trajectory_id_b", whole=True)


def p3_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records per split and source."""
    return _overlap(spark, sf_dir).by_split()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of same records that each trajectory belongs to."""
    return _overlap(spark, sf_dir).membership().withColumnRenamed("record", "trajectory_id").withColumnRenamed("key", "class_id")


QUERIES = {"p3_found": p3_found, "p3_by_split": p3_by_split, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
