"""Schemas of question, corpus, step, trajectory, label, tree and pair files, and their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MESSAGE = "struct<role:string,content:string>"
STEP = "struct<step_id:int,step_type:string,think:string,search:string,answer:string,documents:string>"
QUESTION = "id string, _id string, question string, answer string, gold_answer string, context array<array<string>>, supporting_facts array<string>"
CORPUS = "id string, _id string, title string, wikipedia_title string, text string, contents string"
TRAJECTORY = f"trajectory_id string, question_id string, question string, gold_answer string, final_answer string, predicted_answer string, is_correct boolean, supporting_facts array<string>, metadata map<string,string>, steps array<{STEP}>"
SCHEMA_STEP = "struct<step_id:int,action_type:string,action:string,observation:string,passages:array<string>,metadata:map<string,string>>"
RPE_LABEL = "step_id int, mc_s_t double, mc_s_t_a_t double, rpe double, label string, confidence double"
JUDGE_LABEL = "step_id int, label string, reasoning string, confidence double"
CONSENSUS_LABEL = "step_id int, rpe_label string, judge_label string, consensus_label int, is_consensus boolean, confidence double, filtered_reason string"
SCORED = "trajectory_id string, question string, gold_answer string, predicted_answer string, is_correct boolean, critic_min double, critic_step_scores array<double>, critic_step_labels array<int>"
NODE = "question_id string, question string, gold_answer string, id int, parent_id int, children_ids array<int>, depth int, think string, search_query string, answer_text string, documents string, is_terminal boolean, visit_count int, total_value double, f1_reward double, critic_score int, critic_feedback string"
PAIR = f"prompt array<{MESSAGE}>, chosen array<{MESSAGE}>, rejected array<{MESSAGE}>, question_id string, step_level int, source string, chosen_f1 double, rejected_f1 double, chosen_combined double, rejected_combined double, chosen_critic int, rejected_critic int, chosen_action_type string, rejected_action_type string"
EXPERIMENT = "name string, checkpoints array<struct<name:string,num_samples:int,difficulty_distribution:map<string,int>,status:string,final_loss:double,eval_results:map<string,double>>>"

ACTIONS = ("retrieve", "reason", "answer")
LABELS = ("GOOD", "BAD")


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of several alias columns that isn't null; those the table lacks are skipped."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def normalised_questions(df: DataFrame) -> DataFrame:
    """Question rows with one name for each thing; a missing id is a hash of the question."""
    hashed = F.concat(F.lit("h"), F.hex(F.xxhash64("question")))
    return df.select(F.coalesce(first_of(df, "_id", "id"), hashed).alias("question_id"), "question", first_of(df, "gold_answer", "answer").alias("gold_answer"))


def normalised_trajectories(df: DataFrame) -> DataFrame:
    """Trajectory rows with aliases resolved; other columns stay."""
    resolved = {"trajectory_id": first_of(df, "trajectory_id", "question_id"), "final_answer": first_of(df, "final_answer", "predicted_answer"), "gold_answer": first_of(df, "gold_answer", "answer")}
    return df.withColumns(resolved)


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Raises when a value outside a fixed set is read; nulls pass."""
    wrong = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))).otherwise(F.col(column)))


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Raises when a required value is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df
