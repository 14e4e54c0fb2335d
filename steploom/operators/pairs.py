"""Preference pairs from attempts and from sibling steps of search trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Right attempts from the best and wrong ones from the worst, with their places."""
    good = Window.partitionBy("question_id").orderBy(F.col("critic_min").desc(), "ord")
    bad = Window.partitionBy("question_id").orderBy("critic_min", "ord")
    right = rows.where("is_correct").withColumn("place", F.row_number().over(good)).select("question_id", F.col("trajectory_id").alias("chosen"), F.col("critic_min").alias("chosen_score"), F.col("place").alias("chosen_place"))
    wrong = rows.where("not is_correct").withColumn("place", F.row_number().over(bad)).select("question_id", F.col("trajectory_id").alias("rejected"), F.col("critic_min").alias("rejected_score"), F.col("place").alias("rejected_place"))
    return right, wrong


def attempt_pairs(rows: DataFrame, strategy: str) -> DataFrame:
    """(question_id, chosen, rejected, margin): best_vs_all, best_vs_worst or all_vs_all.

    ``rows``: question_id, ord, trajectory_id, is_correct, critic_min. The first two give at most a
    row an attempt. all_vs_all is quadratic in a question's attempts; for questions with very many
    use :func:`margin_summary`, which needs no pairs.
    """
    right, wrong = _ranked(rows)
    if strategy != "all_vs_all":
        right = right.where("chosen_place = 1")
    if strategy == "best_vs_worst":
        wrong = wrong.where("rejected_place = 1")
    pairs = right.join(wrong, "question_id")
    return pairs.select("question_id", "chosen", "rejected", (F.round(F.col("chosen_score") - F.col("rejected_score"), 6) + 0.0).alias("margin"))


def margin_summary(rows: DataFrame) -> DataFrame:
    """Number and mean margin of all right-against-wrong pairs a question, from sums alone."""
    right, wrong = F.col("is_correct"), ~F.col("is_correct")
    s = rows.groupBy("question_id").agg(
        F.count_if(right).alias("nc"), F.count_if(wrong).alias("nr"), F.sum(F.when(right, F.col("critic_min"))).alias("sc"), F.sum(F.when(wrong, F.col("critic_min"))).alias("sr")
    ).where("nc > 0 and nr > 0")
    mean = F.col("sc") / F.col("nc") - F.col("sr") / F.col("nr")
    return s.select("question_id", (F.col("nc") * F.col("nr")).alias("n_pairs"), (F.round(mean, 10) + 0.0).alias("mean_margin"))


def combined_reward(f1: Column, critic: Column, alpha: float) -> Column:
    """f1 plus alpha times the critic's score; f1 alone where the critic is silent."""
    return f1 + F.coalesce(F.lit(alpha) * critic, F.lit(0.0))


def sibling_pairs(nodes: DataFrame, alpha: float = 0.3, min_diff: float = 0.01, min_f1: float | None = None) -> DataFrame:
    """Pairs of children of one parent, the better one chosen.

    ``nodes``: question_id, id, parent_id, depth, action, text, f1, critic. Pairs with a missing
    reward, equal text or a difference below ``min_diff`` are dropped, as are those whose chosen
    side neither searches, answers nor reasons. ``min_f1`` further asks for that F1 and that lead.
    A parent has a bounded number of children, so the join stays linear.
    """
    scored = nodes.where(F.col("parent_id").isNotNull() & F.col("f1").isNotNull()).withColumn("reward", combined_reward(F.col("f1"), F.col("critic"), alpha))
    a = scored.select("question_id", "parent_id", *(F.col(c).alias(f"a_{c}") for c in ("id", "depth", "action", "text", "f1", "reward")))
    b = scored.select("question_id", "parent_id", *(F.col(c).alias(f"b_{c}") for c in ("id", "action", "text", "f1", "reward")))
    pairs = a.join(b, ["question_id", "parent_id"]).where("a_id < b_id and a_text <> b_text").where(F.abs(F.col("a_reward") - F.col("b_reward")) >= min_diff)
    first = F.col("a_reward") > F.col("b_reward")

    def side(c: str, chosen: bool) -> Column:
        return F.when(first if chosen else ~first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))

    out = pairs.select("question_id", "parent_id", F.col("a_depth").alias("step_level"), *(side(c, True).alias(f"chosen_{c}") for c in ("id", "action", "f1", "reward")), *(side(c, False).alias(f"rejected_{c}") for c in ("id", "action", "f1", "reward")))
    out = out.where("chosen_action <> 'Other'")
    if min_f1 is not None:
        out = out.where((F.col("chosen_f1") >= min_f1) & (F.col("chosen_f1") - F.col("rejected_f1") >= min_f1))
    return out


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Pairs and distinct questions per step level."""
    return pairs.groupBy("step_level").agg(F.count("*").alias("n_pairs"), F.countDistinct("question_id").alias("n_questions"))


def critic_flipped(pairs: DataFrame) -> DataFrame:
    """One row: pairs, and those whose chosen side has the lower F1, so that the critic has decided."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("chosen_f1") < F.col("rejected_f1")).alias("critic_flipped"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id has no result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resumed(rows: DataFrame, done: DataFrame, key: str, value: str, fresh: Column) -> DataFrame:
    """Rows with the stored value where there is one, else a fresh one."""
    return rows.join(done.select(key, F.col(value).alias("__old")), key, "left").withColumn(value, F.coalesce("__old", fresh)).drop("__old")
