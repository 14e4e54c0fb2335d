"""Step labels: Monte-Carlo ratio, agreement of two labellers, label quality, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def rpe_ratio(before: Column, after: Column) -> Column:
    """How much a step changes the success rate; no success before makes any success large."""
    return after / (before + F.lit(EPSILON))


def rpe_label(before: Column, after: Column, threshold: float = 0.5) -> Column:
    return F.when(rpe_ratio(before, after) >= threshold, "GOOD").otherwise("BAD")


def success_rate(matches: Column) -> Column:
    """Aggregate: the share of rollouts that succeed; without a gold answer none does."""
    return F.avg(F.coalesce(matches, F.lit(False)).cast("double"))


def step_consensus(rows: DataFrame) -> DataFrame:
    """Adds consensus_label (1, 0, null), is_consensus, confidence and reason to (rpe, judge, rpe_conf, judge_conf)."""
    both = F.col("rpe") == F.col("judge")
    label = F.when(both & (F.col("rpe") == "GOOD"), 1).when(both & (F.col("rpe") == "BAD"), 0)
    return rows.withColumn("consensus_label", label).withColumn("is_consensus", label.isNotNull()).withColumn(
        "confidence", F.when(label.isNotNull(), F.least("rpe_conf", "judge_conf")).otherwise(0.0)
    ).withColumn("reason", F.when(label.isNull(), F.concat(F.lit("rpe_"), "rpe", F.lit("_judge_"), "judge")))


def trajectory_consensus(steps: DataFrame, key: str, min_agreement: float = 0.8, trajectory_level: bool = True) -> DataFrame:
    """Per trajectory its steps, agreement, whether it is filtered and why; the second reason overrides."""
    rate = F.avg(F.col("is_consensus").cast("double"))
    out = steps.groupBy(key).agg(F.count("*").alias("n_steps"), rate.alias("rate"))
    low = F.col("rate") < min_agreement
    conflict = (F.col("rate") < 1) & F.lit(trajectory_level)
    reason = F.when(low, F.concat(F.lit("agreement_rate_too_low_"), F.format_string("%.2f", "rate"))).when(conflict, "trajectory_level_conflict")
    return out.select(key, "n_steps", F.round("rate", 6).alias("agreement"), (low | conflict).alias("is_filtered"), reason.alias("filter_reason"))


def consensus_statistics(steps: DataFrame) -> DataFrame:
    """One row: labels by value and the agreement over all steps."""
    label = F.col("consensus_label")
    return steps.agg(
        F.count("*").alias("n_steps"), F.count_if(label == 1).alias("n_good"), F.count_if(label == 0).alias("n_bad"), F.count_if(label.isNull()).alias("n_filtered"),
        F.round(F.try_divide(F.count_if("is_consensus"), F.count("*")), 6).alias("agreement"),
    )


def confident(steps: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """Trajectories whose mean consensus confidence reaches ``least``."""
    return steps.groupBy(key).agg(F.avg("confidence").alias("c")).where(F.col("c") >= least).select(key, F.round("c", 6).alias("avg_confidence"))


def agreement_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement rate and Cohen's kappa of two 0/1 columns."""
    n = F.count("*")
    both, left, right = F.sum(F.col(a) * F.col(b)), F.sum(a), F.sum(b)
    counts = rows.agg(n.alias("n"), both.alias("both"), left.alias("l"), right.alias("r"))
    po = (F.col("both") * 2 + F.col("n") - F.col("l") - F.col("r")) / F.col("n")
    pe = (F.col("l") * F.col("r") + (F.col("n") - F.col("l")) * (F.col("n") - F.col("r"))) / (F.col("n") * F.col("n"))
    return counts.select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def label_quality(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of 0/1 columns; 0 where undefined."""
    p, g = F.col(predicted) == 1, F.col(gold) == 1
    c = rows.agg(F.count("*").alias("n"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    return c.select("n", ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def coverage(total: int, filtered: int) -> tuple[float, float]:
    """(coverage, filter rate) of a filtering step."""
    return (0.0, 0.0) if total == 0 else ((total - filtered) / total, filtered / total)
