"""Problem 1: the best scored trajectories of every question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.columns import question_of
from steploom.llm.topn import top_n_per_group
from steploom.sources import read_table


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read_table(spark, sf_dir, "scored_trajectories")
    rows = scored.select(question_of(F.col("question_id"), F.col("trajectory_id")).alias("question_id"), "trajectory_id", "critic_min")
    return top_n_per_group(rows, "question_id", "critic_min", "trajectory_id", 3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("question_id", "trajectory_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With score and place."""
    return _top(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked}

_RANKED = """
with named as (
  select coalesce(question_id, regexp_replace(trajectory_id, '^(.*)_sample_.*$', '\\1', 's')) as question_id, trajectory_id, critic_min
  from scored_trajectories),
best as (
  select question_id, trajectory_id, max(critic_min) as critic_min from named
  where critic_min is not null and not isnan(critic_min) and question_id is not null and trajectory_id is not null
  group by question_id, trajectory_id),
placed as (
  select *, cast(row_number() over (partition by question_id order by critic_min desc, trajectory_id) as integer) as rank from best)
"""
SQL = {
    "p1_found": _RANKED + "select question_id, trajectory_id from placed where rank <= 3",
    "p1_ranked": _RANKED + "select question_id, trajectory_id, critic_min, rank from placed where rank <= 3",
}
