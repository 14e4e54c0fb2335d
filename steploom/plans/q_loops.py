"""Queries over the loops that call models, with deterministic stand-ins, held against what must be true of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import models, search_loop
from steploom.plans import views
from steploom.plans.storage import store
from steploom.sources import files, read_table

ROLLOUTS, SAMPLES, ROUNDS, STEPS = 3, 2, 2, 3


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.distinct_questions(read_table(spark, sf_dir, "trajectories").where("trajectory_id is not null"))
    return found.select("question_id", F.coalesce("question", F.lit("?")).alias("question"), F.coalesce("gold_answer", F.lit("")).alias("gold"))


def _mixed() -> models.ReplayModel:
    return models.ReplayModel(["so</think><search>when was it sold</search>", "then</think><answer>yes</answer>", "so</think>"])


def _searching() -> models.ReplayModel:
    return models.ReplayModel(["so</think><search>where is it</search>"])


def _acting() -> models.ReplayModel:
    return models.ReplayModel(["Action: search[where is it]", "Action: finish[yes]", "no action at all"])


def tree_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after a few rollouts: every rollout visits the root, adds a node at most, and the critic leaves none unrated."""
    critic = lambda rows: rows.withColumn("score", F.lit(1))
    nodes = search_loop.grow(_questions(spark, sf_dir), _mixed, critic, rollouts=ROLLOUTS, max_depth=3, critic_every=2)
    root = F.max(F.when(F.col("parent_id").isNull(), F.col("visit_count")))
    trees = nodes.groupBy("question_id").agg(root.alias("visits"), F.count("*").alias("n"), F.count_if(~F.col("scored")).alias("unrated"))
    return trees.select("question_id", "visits", F.col("n").between(2, ROLLOUTS + 1).alias("bounded"), (F.col("unrated") == 0).alias("rated"))


def tree_regeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and depth of trees regenerated for two rounds by a model that always searches."""
    state = store(search_loop.roots(_questions(spark, sf_dir)), "roots")
    targets = state.select("question_id", F.col("id").alias("bad_id"), F.lit("wrong").alias("feedback"))
    nodes = search_loop.regenerate_frontier(state, targets, _searching, rounds=ROUNDS, samples=SAMPLES)
    return nodes.groupBy("question_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("id").alias("n_ids"), F.max("depth").alias("depth"))


def generated_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories grown step by step: finished with an answer, or of the most steps without one."""
    made = models.generation_loop(_questions(spark, sf_dir).select("question_id", "question"), _acting, max_steps=STEPS)
    whole = F.when(F.col("finished"), F.col("final_answer") == "yes").otherwise((F.size("steps") == STEPS) & F.col("final_answer").isNull())
    return made.select("question_id", whole.alias("whole"), F.size("steps").between(1, STEPS).alias("bounded"))


_QUESTIONS = f"select distinct {views.QID} as question_id from trajectories where trajectory_id is not null"

QUERIES = {"tree_growth": tree_growth, "tree_regeneration": tree_regeneration, "generated_trajectories": generated_trajectories}
SQL = {
    "tree_growth": f"select question_id, cast({ROLLOUTS} as bigint) as visits, true as bounded, true as rated from ({_QUESTIONS})",
    "tree_regeneration": f"select question_id, cast({1 + SAMPLES + SAMPLES**ROUNDS} as bigint) as n_nodes, cast({1 + SAMPLES + SAMPLES**ROUNDS} as bigint) as n_ids, cast({ROUNDS} as integer) as depth from ({_QUESTIONS})",
    "generated_trajectories": f"select question_id, true as whole, true as bounded from ({_QUESTIONS})",
}
