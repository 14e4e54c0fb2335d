"""Scaling experiments as a small control table, sampling predicates, shards and summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators.scaling import advanced

MAX_PATHS = 2048


@dataclass
class Checkpoint:
    name: str
    num_samples: int
    status: str = "pending"
    final_loss: float | None = None
    resume_from: str | None = None
    eval_results: dict[str, float] = field(default_factory=dict)


class Callbacks:
    """What a run calls as it goes on; a subclass overrides what it wants to hear of."""

    def on_log(self, checkpoint: Checkpoint, metrics: dict[str, float]) -> None: ...

    def on_step_end(self, checkpoint: Checkpoint) -> None: ...

    def on_train_end(self, checkpoints: list[Checkpoint]) -> None: ...


class MetricLog(Callbacks):
    """Keeps what was logged, as rows for a metrics table."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, float]] = []

    def on_log(self, checkpoint: Checkpoint, metrics: dict[str, float]) -> None:
        self.rows += [(checkpoint.name, name, float(value)) for name, value in metrics.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "checkpoint string, metric string, value double")


def run_name(prefix: str, at: datetime) -> str:
    """A name for a run that sorts by time."""
    return f"{prefix}_{at:%Y%m%d_%H%M%S}"


class Experiment:
    """Prepares, trains and evaluates checkpoints in order; the state is saved after every transition.

    ``train`` and ``evaluate`` are callbacks on the driver; without them a checkpoint's loss and
    results stay empty. Finished checkpoints are passed over, so a run that stopped goes on.
    """

    def __init__(self, name: str, checkpoints: list[Checkpoint], save: Callable[[list[Checkpoint]], None] | None = None, callbacks: tuple[Callbacks, ...] = ()):
        self.name, self.checkpoints, self.save = name, checkpoints, save or (lambda _: None)
        self.callbacks = callbacks
        self.train: Callable[[Checkpoint], float] | None = None
        self.evaluate: Callable[[Checkpoint], dict[str, float]] | None = None

    def run(self, start_from: str | None = None) -> list[Checkpoint]:
        on, before = start_from is None, None
        for c in self.checkpoints:
            on = on or c.name == start_from
            if on and c.status != "evaluated":
                c.resume_from = before
                while c.status != "evaluated":
                    if c.status == "in_progress" and self.train:
                        c.final_loss = self.train(c)
                        self._tell("on_log", c, {"loss": c.final_loss})
                    if c.status == "completed" and self.evaluate:
                        c.eval_results = self.evaluate(c)
                        self._tell("on_log", c, c.eval_results)
                    c.status = advanced(c.status)
                    self.save(self.checkpoints)
                    self._tell("on_step_end", c)
            before = c.name
        self._tell("on_train_end", self.checkpoints)
        return self.checkpoints

    def _tell(self, what: str, *args: object) -> None:
        for c in self.callbacks:
            getattr(c, what)(*args)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a checkpoint."""
        rows = [(self.name, c.name, c.num_samples, c.status, c.final_loss, c.resume_from, c.eval_results) for c in self.checkpoints]
        return spark.createDataFrame(rows, "experiment string, name string, num_samples int, status string, final_loss double, resume_from string, eval_results map<string,double>")

    def summary(self) -> str:
        """A line a checkpoint."""
        lines = [f"{c.name}: {c.num_samples} samples, {c.status}" + (f", loss {c.final_loss:.4f}" if c.final_loss is not None else "") for c in self.checkpoints]
        return "\n".join([f"experiment {self.name}", *lines])


def keep_sampling(n_paths: Column, n_right: Column, n_wrong: Column, max_paths: int = MAX_PATHS) -> Column:
    """Whether a question needs more paths: not full, and a right or a wrong one is still missing."""
    return (n_paths < max_paths) & ((n_right == 0) | (n_wrong == 0))


def useful_question(n_right: Column, n_wrong: Column) -> Column:
    """Whether a question has both right and wrong paths to learn from."""
    return (n_right > 0) & (n_wrong > 0)


def shard(df: DataFrame, key: str, rank: int, world: int) -> DataFrame:
    """The rows of one of ``world`` disjoint shards."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(world)) == rank)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def masking_summary(rows: DataFrame, total: str, masked: str) -> DataFrame:
    """One row: tokens, masked tokens and their share; masked ones can't exceed all."""
    checked = rows.withColumn(masked, F.when(F.col(masked) > F.col(total), F.raise_error(F.lit("more masked than there are"))).otherwise(F.col(masked)))
    s = checked.agg(F.sum(total).alias("n_tokens"), F.sum(masked).alias("n_masked"))
    return s.withColumn("masked_pct", F.round(100 * F.coalesce(F.try_divide("n_masked", "n_tokens"), F.lit(0.0)), 6))


def running_accuracy(batches: DataFrame, order: str, right: str) -> DataFrame:
    """Accuracy so far after each of a control table's batches."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("accuracy_so_far", F.sum(right).over(w) / F.sum("n").over(w))
