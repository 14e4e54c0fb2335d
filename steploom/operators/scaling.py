"""Scaling curves over checkpoints: power-law fits, comparison, the state of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = ("completed", "evaluated")
STATES = ("pending", "in_progress", "completed", "evaluated")


def fit_power_law(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, a, b, c, r2, n): y = a x^b + c, R^2 in the space of y.

    Log-log least squares (c = 0) when all values are positive, else a straight line (b = 1). Fewer than
    two points give zeros; points at one x give a = 1 and nothing else. A group is a curve's points,
    a bounded handful.
    """
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    base = points.select(key, x_.alias("x"), y_.alias("y")).where("x is not null and y is not null")
    logs = base.withColumn("lx", F.log(F.when(F.col("x") > 0, F.col("x")))).withColumn("ly", F.log(F.when(F.col("y") > 0, F.col("y"))))

    def spread(c: str) -> Column:
        return F.count("*") * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)

    def slope(a: str, b: str) -> Column:
        return F.try_divide(F.count("*") * F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b), spread(a))

    fits = logs.groupBy(key).agg(
        F.count("*").alias("n"), F.min((F.col("x") > 0) & (F.col("y") > 0)).alias("positive"), spread("x").alias("sx"), spread("lx").alias("sl"),
        slope("x", "y").alias("m"), slope("lx", "ly").alias("p"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.avg("lx").alias("al"), F.avg("ly").alias("am"),
    )
    flat = F.when(F.col("positive"), F.abs(F.col("sl")) <= 1e-10).otherwise(F.abs(F.col("sx")) <= 1e-10)
    few = F.col("n") < 2
    a = F.when(few, 0.0).when(flat, 1.0).when(F.col("positive"), F.exp(F.col("am") - F.col("p") * F.col("al"))).otherwise(F.col("m"))
    b = F.when(few | flat, 0.0).when(F.col("positive"), F.col("p")).otherwise(1.0)
    c = F.when(few | flat | F.col("positive"), 0.0).otherwise(F.col("ay") - F.col("m") * F.col("ax"))
    curves = fits.select(key, "n", "ay", (few | flat).alias("none"), a.alias("a"), b.alias("b"), c.alias("c"))
    errors = base.join(curves, key)
    residual = F.pow(F.col("y") - predict(F.col("a"), F.col("b"), F.col("c"), F.col("x")), 2)
    total = F.pow(F.col("y") - F.col("ay"), 2)
    r2 = F.when(F.max("none") | (F.sum(total) == 0), 0.0).otherwise(1 - F.try_divide(F.sum(residual), F.sum(total)))
    return errors.groupBy(key, "n", "a", "b", "c").agg(r2.alias("r2")).select(key, "n", *(F.round(v, 6).alias(v) for v in ("a", "b", "c", "r2")))


def predict(a: Column, b: Column, c: Column, n: Column) -> Column:
    return a * F.pow(n, b) + c


def fit_grid(curves: DataFrame, low: Column, high: Column, points: int = 100) -> DataFrame:
    """Rows of a fitted curve to be plotted, at even steps from ``low`` to ``high``."""
    steps = curves.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", low + (high - low) * F.col("i") / (points - 1))
    return steps.withColumn("y", predict(F.col("a"), F.col("b"), F.col("c"), F.col("x")))


def usable_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(F.col("status").isin(*KEPT))


def compare_checkpoints(points: DataFrame, key: str, size: str, value: str) -> DataFrame:
    """First against last checkpoint by size (of equals by value): values and improvement in percent (infinite from 0)."""
    order = F.struct(size, value)
    first, last = F.min_by(value, order), F.max_by(value, order)
    s = points.groupBy(key).agg(first.alias("first_value"), last.alias("last_value"), F.min(size).alias("first_size"), F.max(size).alias("last_size"))
    gain = F.when(F.col("first_value") == 0, float("inf")).otherwise(100 * (F.col("last_value") - F.col("first_value")) / F.abs("first_value"))
    return s.select(key, "first_size", "last_size", F.round("first_value", 6).alias("first_value"), F.round("last_value", 6).alias("last_value"), F.round(gain, 6).alias("improvement_pct"))


def resume_chain(checkpoints: DataFrame, experiment: str, order: str) -> DataFrame:
    """Each checkpoint with the one before it, to be resumed from."""
    return checkpoints.withColumn("resume_from", F.lag("name").over(Window.partitionBy(experiment).orderBy(order)))


def from_checkpoint(checkpoints: DataFrame, experiment: str, order: str, name: str) -> DataFrame:
    """The checkpoints from a named one on."""
    seen = F.max((F.col("name") == name).cast("int")).over(Window.partitionBy(experiment).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return checkpoints.withColumn("__on", seen).where("__on = 1").drop("__on")


def advanced(status: str) -> str:
    """The state after this one; the last stays."""
    return STATES[min(STATES.index(status) + 1, len(STATES) - 1)]


def latest_checkpoint(names: DataFrame, column: str) -> DataFrame:
    """The name with the highest number at its end."""
    number = F.regexp_extract(column, r"-(\d+)$", 1).try_cast("long")
    return names.agg(F.max_by(column, number).alias("latest"))
