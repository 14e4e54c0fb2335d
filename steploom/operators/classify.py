"""Questions and trajectories sorted by outcome: merging, cases, truncation, difficulty, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.answers import match_unquoted


def last_per_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every id (later repeats win), by one aggregate."""
    others = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(key).agg(last.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def merge_scores(trajectories: DataFrame, scores: DataFrame) -> DataFrame:
    """Trajectories with their critic scores; labels follow from scores where they are missing."""
    joined = trajectories.join(scores, "trajectory_id")
    derived = F.transform("critic_step_scores", lambda s: F.when(s > 0.5, 1).otherwise(0))
    return joined.withColumn("critic_step_labels", F.coalesce("critic_step_labels", derived))


def classify_questions(rows: DataFrame) -> DataFrame:
    """Case A (some attempt is right) or B per question, with its best attempt by critic_min.

    ``rows``: question_id, ord, trajectory_id, answer, gold, critic_min. Whether an attempt is right
    is found anew against the gold answer of the question's first attempt. The best attempt is
    chosen among the right ones, or among all where there is none.
    """
    first = F.min_by("gold", "ord").over(Window.partitionBy("question_id"))
    judged = rows.withColumn("right", match_unquoted(F.col("answer"), first))
    rank = F.struct(F.col("right"), F.col("critic_min"), -F.col("ord"))
    out = judged.groupBy("question_id").agg(F.count("*").alias("num_total"), F.count_if("right").alias("num_correct"), F.max_by("trajectory_id", rank).alias("best_trajectory"))
    return out.select("question_id", F.when(F.col("num_correct") > 0, "A").otherwise("B").alias("case"), "best_trajectory", "num_correct", "num_total")


def best_per_question(rows: DataFrame) -> DataFrame:
    """The attempt with the highest critic_min of every question, the first of equals."""
    best = F.max_by("trajectory_id", F.struct("critic_min", -F.col("ord")))
    return rows.groupBy("question_id").agg(best.alias("trajectory_id"), F.max("critic_min").alias("critic_min"))


def take_until_bad(labels: Column) -> Column:
    """The labels up to and with the first 0; all of them if there is none."""
    at = F.array_position(labels, 0)
    return F.when(at > 0, F.slice(labels, 1, at.cast("int"))).otherwise(labels)


def first_bad(labels: Column) -> Column:
    """Place (from 0) of the first 0, the last place if there is none; null for no labels."""
    at = F.array_position(labels, 0).cast("int")
    return F.when(F.size(labels) == 0, None).when(at > 0, at - 1).otherwise(F.size(labels) - 1)


def truncate_at_bad(labels: Column, scores: Column) -> Column:
    """struct(n_good, bad_index, bad_score, n_discarded): what stays before the first bad step."""
    at = first_bad(labels)
    return F.struct(at.alias("n_good"), at.alias("bad_index"), F.coalesce(F.get(scores, at), F.lit(0.0)).alias("bad_score"), (F.size(labels) - at - 1).alias("n_discarded"))


def difficulty(mean_success: Column, consensus_rate: Column, n_steps: Column) -> Column:
    """easy, medium or hard by mean success and consensus; hard without steps."""
    high = F.when(consensus_rate >= 0.9, "easy").otherwise("medium")
    return F.when(n_steps == 0, "hard").when(mean_success >= 0.7, high).when(mean_success >= 0.3, "medium").otherwise("hard")


def hash_place(number: Column) -> Column:
    """A place in [0, 2^32) for an integer key; the same in any engine that has modulo."""
    return F.pmod(number * F.lit(2654435761), F.lit(4294967296))


def stratified_sample(rows: DataFrame, stratum: str, place: Column, targets: dict[str, int]) -> DataFrame:
    """min(target, available) rows of every stratum, by hash order; nested as targets grow."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(place))
    wanted = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    # the plain bound lets Spark keep that many rows a task and stratum before it shuffles and sorts
    bounded = rows.withColumn("place", n).where(F.col("place") <= max([0, *targets.values()]))
    return bounded.where(F.col("place") <= F.coalesce(F.element_at(wanted, F.col(stratum)), F.lit(0)))


def checkpoint_sizes(rows: DataFrame, stratum: str, place: Column, checkpoints: list[tuple[str, dict[str, int]]]) -> DataFrame:
    """(checkpoint, stratum, size): cumulative samples, each containing the one before."""
    total: dict[str, int] = {}
    parts = []
    for name, targets in checkpoints:
        total = {k: total.get(k, 0) + targets.get(k, 0) for k in {*total, *targets}}
        parts.append(stratified_sample(rows, stratum, place, dict(sorted(total.items()))).groupBy(stratum).agg(F.count("*").alias("size")).select(F.lit(name).alias("checkpoint"), stratum, "size"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
