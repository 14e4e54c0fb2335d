"""Problem 2: cut reasonings and step texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.truncation import Truncation
from steploom.sources import read_table


def _tables(spark: SparkSession, sf_dir: str) -> list[tuple[str, Truncation]]:
    return [
        ("judge_label", Truncation(read_table(spark, sf_dir, "judge_labels"), "label_id", "source", "reasoning")),
        ("adaptive_step", Truncation(read_table(spark, sf_dir, "adaptive_steps"), "step_row_id", "source", "text")),
    ]


def _each(spark: SparkSession, sf_dir: str, part) -> DataFrame:
    first, second = (part(t).select(F.lit(kind).alias("record_type"), "*") for kind, t in _tables(spark, sf_dir))
    return first.unionByName(second)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, Truncation.cut).select("record_type", F.col("record").alias("record_id"))


def p2_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows per source."""
    return _each(spark, sf_dir, Truncation.by_source)


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field limits found per source."""
    return _each(spark, sf_dir, Truncation.limits).withColumn("posterior", F.round("posterior", 6))


QUERIES = {"p2_found": p2_found, "p2_by_source": p2_by_source, "p2_limits": p2_limits}
SQL: dict[str, str] = {}
