"""Choosing an answer per question from several scored attempts, and comparing the ways to choose.

All take rows (question_id, ord, answer, score): ``ord`` is the arrival order and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.answers import f1_board, match_contains
from steploom.functions.text import strip, vote_key


def step_score(scores: Column, method: str) -> Column:
    """Steps' scores as one: min, product or avg; 0 for none."""
    some = F.size(scores) > 0
    value = {
        "min": F.array_min(scores),
        "product": F.aggregate(scores, F.lit(1.0), lambda a, x: a * x),
        "avg": F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1)),
    }[method]
    return F.when(some, value).otherwise(0.0)


def _counted(votes: DataFrame, by: list[str]) -> DataFrame:
    """Per question and vote key: votes, summed score, first arrival, the answer as it came first, and the best attempt.

    Attempts without an answer are a key of their own, null.
    """
    usable = F.coalesce(strip(F.col("answer")), F.lit("")) != ""
    first = F.min(F.struct("ord", "answer"))
    best = F.max(F.struct(F.col("score").alias("value"), (-F.col("ord")).alias("late"), "answer"))
    grouped = votes.groupBy(*by, "question_id", F.when(usable, vote_key(F.col("answer"))).alias("key"), (~usable).alias("blank"))
    return grouped.agg(F.count("*").alias("n"), F.sum("score").alias("weight"), first["ord"].alias("ord"), first["answer"].alias("answer"), best.alias("best"))


METHODS = ("majority", "weighted", "best_of_n")


def _winners(votes: DataFrame, by: list[str], methods: tuple[str, ...]) -> DataFrame:
    """(by, question_id, n_attempts, and a struct(value, late, answer) for each method), from one aggregate of the votes."""
    counted = _counted(votes, by)
    value = {"majority": F.col("n").cast("double"), "weighted": F.round("weight", 9)}
    chosen = {m: F.max(F.when(~F.col("blank"), F.struct(value[m].alias("value"), (-F.col("ord")).alias("late"), "answer"))) for m in value}
    chosen["best_of_n"] = F.max("best")
    return counted.groupBy(*by, "question_id").agg(F.sum("n").alias("n_attempts"), *(chosen[m].alias(m) for m in methods))


def chosen_by(votes: DataFrame, method: str) -> DataFrame:
    w = _winners(votes, [], (method,)).where(F.col(method).isNotNull())
    return w.select("question_id", F.col(method)["answer"].alias("answer"), F.col(method)["value"].alias("value"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """(question_id, answer, value): the answer given most often."""
    return chosen_by(votes, "majority")


def weighted_vote(votes: DataFrame) -> DataFrame:
    """The answer whose attempts have the highest summed score."""
    return chosen_by(votes, "weighted")


def best_of_n(votes: DataFrame) -> DataFrame:
    """The answer of the attempt with the highest score."""
    return chosen_by(votes, "best_of_n")


def all_choices(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, method, question_id, answer, value) of every method."""
    by = by or []
    listed = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m)["answer"].alias("answer"), F.col(m)["value"].alias("value"), F.col(m).isNotNull().alias("on")) for m in METHODS))
    rows = _winners(votes, by, METHODS).select(*by, "question_id", F.explode(listed).alias("c")).where("c.on")
    return rows.select(*by, "c.method", "question_id", "c.answer", "c.value")


def leaderboard(votes: DataFrame, golds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, method, total, correct, em, f1) in percent: cover match and token F1 against ``golds`` (question_id, gold)."""
    by = by or []
    judged = all_choices(votes, by).join(golds, "question_id")
    right = match_contains(F.col("answer"), F.col("gold")).cast("int")
    scored = judged.select(*by, "method", right.alias("right"), F.coalesce(f1_board(F.col("answer"), F.col("gold")), F.lit(0.0)).alias("f1"))
    return scored.groupBy(*by, "method").agg(
        F.count("*").alias("total"), F.sum("right").alias("correct"), F.round(100 * F.avg("right"), 6).alias("em"), F.round(100 * F.avg("f1"), 6).alias("f1")
    )


SCORINGS = ("min", "product", "avg")


def scoring_grid(votes: DataFrame, golds: DataFrame, scores: str, digits: int = 6) -> DataFrame:
    """(scoring, method, total, correct, em, f1): every way to make one score of an attempt's steps against every way to vote.

    ``scores`` is an array of step scores; they take the place of ``score``. Scores are rounded, so that
    equal ones stay equal however they were worked out.
    """
    each = F.array(*(F.struct(F.lit(m).alias("scoring"), F.round(step_score(F.col(scores), m), digits).alias("score")) for m in SCORINGS))
    rows = votes.withColumn("__each", F.explode(each)).select("question_id", "ord", "answer", F.col("__each.scoring").alias("scoring"), F.col("__each.score").alias("score"))
    return leaderboard(rows, golds, ["scoring"])


def details(votes: DataFrame) -> DataFrame:
    """One row a question: attempts, and what each method chooses."""
    return _winners(votes, [], METHODS).select("question_id", "n_attempts", *(F.col(m)["answer"].alias(m) for m in METHODS))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group by a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
