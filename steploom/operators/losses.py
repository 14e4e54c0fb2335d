"""The arithmetic of preference losses and of metric logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log-probability of the entry at ``index`` (from 0)."""
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def kto_loss(log_ratio: Column, z0: Column, good: Column, beta: float = 0.1, w_good: float = 1.0, w_bad: float = 1.0) -> Column:
    """1 - sigmoid of the clipped log-ratio's lead over the baseline, mirrored for bad steps, weighted."""
    clipped = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), log_ratio))
    up, down = sigmoid(F.lit(beta) * (clipped - z0)), sigmoid(F.lit(beta) * (z0 - clipped))
    return F.when(good, w_good * (1 - up)).otherwise(w_bad * (1 - down))


def dpo_loss(chosen: Column, rejected: Column, beta: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.1) -> Column:
    """Loss of the difference of summed log-ratios: sigmoid, ipo (squared distance from 1 / 2 beta), hinge,
    or robust (sigmoid with a share of labels taken to be the wrong way round)."""
    lead = chosen - rejected
    if kind == "sigmoid":
        return -log_sigmoid(F.lit(beta) * lead)
    if kind == "ipo":
        return F.pow(lead - F.lit(1 / (2 * beta)), 2)
    if kind == "hinge":
        return F.greatest(F.lit(0.0), 1 - F.lit(beta) * lead)
    if kind == "robust":
        return (-(1 - smoothing) * log_sigmoid(F.lit(beta) * lead) + smoothing * log_sigmoid(F.lit(-beta) * lead)) / (1 - 2 * smoothing)
    raise ValueError(f"unknown loss {kind}")


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of the values whose mask is true."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def lagged_ema(batches: DataFrame, run: str, order: str, value: str, decay: float = 0.1) -> DataFrame:
    """Adds z0 = max(0, ema before the row) and ema after it, per run in order (equal orders by value).

    A null value leaves the average as it is. Rows are sorted by run and order and stream past, with one
    number kept, so a run of any length is neither gathered in a row nor held in memory.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ema, begun = None, 0.0, False
        for part in parts:
            names = part.column(0).to_pylist()
            z0, after = np.empty(len(names)), np.empty(len(names))
            for k, (name, x) in enumerate(zip(names, part.column(2).to_pylist(), strict=True)):
                if not begun or name != at:
                    at, ema, begun = name, 0.0, True
                z0[k] = max(0.0, ema)
                ema = ema if x is None else (1 - decay) * ema + decay * x
                after[k] = ema
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z0), pa.array(after)], [run, order, "z0", "ema"])

    kind = {c: batches.schema[c].dataType.simpleString() for c in (run, order)}
    rows = batches.select(run, order, F.col(value).cast("double").alias("__value"))
    ordered = rows.repartition(run).sortWithinPartitions(run, order, "__value")
    return ordered.mapInArrow(fold, f"`{run}` {kind[run]}, `{order}` {kind[order]}, z0 double, ema double")


def collapsed_at(log: DataFrame, run: str, step: str, loss: str, kl: str, warmup: int = 30) -> DataFrame:
    """(run, step, reason): the first step after warm-up at which a run has collapsed."""
    reason = F.when(F.col(loss) < 0.05, "loss").when(F.col(kl) < -5, "kl")
    return log.where((F.col(step) >= warmup) & reason.isNotNull()).groupBy(run).agg(F.min(F.struct(F.col(step).alias("step"), reason.alias("reason"))).alias("f")).select(run, "f.step", "f.reason")


def recent_window(log: DataFrame, run: str, order: list[str], value: str, size: int = 10) -> DataFrame:
    """Mean, minimum and maximum of the last ``size`` values up to each row."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(1 - size, 0)
    return log.withColumn("recent_avg", F.avg(value).over(w)).withColumn("recent_min", F.min(value).over(w)).withColumn("recent_max", F.max(value).over(w))


def loss_history(log: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """Per run: first, last, lowest, highest and mean value, and the reduction in percent."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    s = log.groupBy(run).agg(first.alias("f"), last.alias("l"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("m"), F.count("*").alias("n"))
    return s.select(run, "n", F.round("f", 6).alias("first"), F.round("l", 6).alias("last"), F.round("lo", 6).alias("lowest"), F.round("hi", 6).alias("highest"), F.round("m", 6).alias("mean"), F.round(100 * F.try_divide(F.col("f") - F.col("l"), F.col("f")), 6).alias("reduction_pct"))
