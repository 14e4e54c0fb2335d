"""Where models plug in, with deterministic stand-ins, and the loops that call them.

A model is a function over batches of text. It runs inside ``mapInPandas``, made once a Python
worker, and sees whole batches; a batch that fails is tried again and then given default rows. The
loops below are driver rounds over the rows that are still active.
"""

from __future__ import annotations

import hashlib
import logging
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.functions.parse import action_of, own_step
from steploom.plans.storage import store


logger = logging.getLogger(__name__)


class TextModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, left: list[str], right: list[str]) -> list[float]: ...


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class StepScorer(Protocol):
    def score_steps(self, texts: list[list[str]]) -> list[list[float]]: ...


class OverlapStepScorer:
    """Each step by the share of its words that the step before it has too; 1 for a first step."""

    def score_steps(self, texts: list[list[str]]) -> list[list[float]]:
        pair = OverlapScorer()
        return [[1.0] * min(1, len(steps)) + pair.score(steps[:-1], steps[1:]) for steps in texts]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class ReplayModel:
    """Answers from a fixed list, chosen by the prompt's hash; the same on every run and worker."""

    def __init__(self, responses: list[str]):
        self.responses = responses

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.responses[_digest(p) % len(self.responses)] for p in prompts]


class HashedBagEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = _digest(word)
                row[h % self.width] += 1 if h >> 40 & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class OverlapScorer:
    """Share of the words of both texts that they have in common."""

    def score(self, left: list[str], right: list[str]) -> list[float]:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = set((a or "").lower().split()), set((b or "").lower().split())
            out.append(len(x & y) / max(1, len(x | y)))
        return out


def score_batches(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, tries: int = 3, default: dict | None = None, pause: float = 0.1) -> DataFrame:
    """Columns that a batch function adds to every row; ``make`` is called once a worker.

    ``schema`` names what is added. If the function fails ``tries`` times on a batch, ``default`` is
    written for its rows; without one the error is raised. Every failure is logged, and the pause
    before another attempt doubles from ``pause`` seconds.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = make()
        for batch in batches:
            for attempt in range(tries):
                try:
                    yield pd.concat([batch.reset_index(drop=True), function(batch).reset_index(drop=True)], axis=1)
                    break
                except Exception as error:
                    logger.warning("a batch of %d rows failed, attempt %d of %d: %s", len(batch), attempt + 1, tries, error)
                    if attempt < tries - 1:
                        time.sleep(pause * 2**attempt)
                        continue
                    if default is None:
                        raise
                    yield batch.assign(**default)

    return df.mapInPandas(run, f"{kept}, {schema}")


def generated(df: DataFrame, prompt: str, model: Callable[[], TextModel], out: str = "response", default: str | None = None) -> DataFrame:
    """``df`` with a model's response to each prompt."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        m = model()
        return lambda batch: pd.DataFrame({out: m.generate(batch[prompt].fillna("").tolist())})

    return score_batches(df, make, f"`{out}` string", default=None if default is None else {out: default})


def embedded(df: DataFrame, text: str, model: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    """``df`` with a text's vector."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        m = model()
        return lambda batch: pd.DataFrame({out: list(m.embed(batch[text].fillna("").tolist()))})

    return score_batches(df, make, f"`{out}` array<float>")


def pair_scored(df: DataFrame, left: str, right: str, model: Callable[[], PairScorer], out: str = "rerank_score") -> DataFrame:
    """``df`` with a pair score, as a cross-encoder gives."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        m = model()
        return lambda batch: pd.DataFrame({out: m.score(batch[left].fillna("").tolist(), batch[right].fillna("").tolist())})

    return score_batches(df, make, f"`{out}` double")


def step_scored(df: DataFrame, steps: str, model: Callable[[], StepScorer], out: str = "step_scores") -> DataFrame:
    """``df`` with a score for every text of the array ``steps``; no scores for a null array."""

    def make() -> Callable[[pd.DataFrame], pd.DataFrame]:
        m = model()
        return lambda batch: pd.DataFrame({out: m.score_steps([[] if x is None else [t or "" for t in x] for x in batch[steps]])})

    return score_batches(df, make, f"`{out}` array<double>")


class Labeler(ABC):
    """Labels a table of steps."""

    @abstractmethod
    def transform(self, steps: DataFrame) -> DataFrame: ...


class RolloutLabeler(Labeler):
    """Monte-Carlo ratio labels: rollouts before and after every step, compared with the gold answer."""

    def __init__(self, model: Callable[[], TextModel], matches: Callable, n_rollouts: int = 5, threshold: float = 0.5):
        self.model, self.matches, self.n, self.threshold = model, matches, n_rollouts, threshold

    def transform(self, steps: DataFrame) -> DataFrame:
        """``steps``: key columns, prefix_before, prefix_after, gold. Adds mc_before, mc_after, rpe, label."""
        from steploom.operators.labeling import rpe_label, rpe_ratio, success_rate

        keys = [c for c in steps.columns if c not in ("prefix_before", "prefix_after", "gold")]
        phases = F.array(F.struct(F.lit("before").alias("phase"), F.col("prefix_before").alias("text")), F.struct(F.lit("after").alias("phase"), F.col("prefix_after").alias("text")))
        tries = steps.select(*keys, "gold", F.explode(phases).alias("p")).select(*keys, "gold", "p.phase", F.explode(F.sequence(F.lit(1), F.lit(self.n))).alias("k"), F.col("p.text").alias("t"))
        tries = tries.withColumn("prompt", F.concat("t", F.lit("\n#"), F.col("k").cast("string")))
        done = generated(tries, "prompt", self.model).withColumn("hit", self.matches(F.col("response"), F.col("gold")))
        rates = done.groupBy(*keys).pivot("phase", ["before", "after"]).agg(success_rate(F.col("hit")))
        rates = rates.withColumnRenamed("before", "mc_before").withColumnRenamed("after", "mc_after")
        return rates.withColumn("rpe", rpe_ratio(F.col("mc_before"), F.col("mc_after"))).withColumn("label", rpe_label(F.col("mc_before"), F.col("mc_after"), self.threshold))


MARGIN = 10  # tokens that are kept free behind a prompt


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def generation_loop(questions: DataFrame, model: Callable[[], TextModel], retriever: Callable[[DataFrame], DataFrame] | None = None, max_steps: int = 10, max_length: int | None = None, length: Callable[[Column], Column] = word_count) -> DataFrame:
    """Trajectories (question_id, question, steps, final_answer, finished) grown a step a round.

    Every round prompts the questions still active, reads the action, searches for those that ask
    (``retriever``: rows with ``input`` to rows with ``observation``) and stops those that answer. A
    response without a readable action counts as reasoning. A question whose prompt comes within MARGIN
    of ``max_length`` (by ``length``, of words without a tokenizer) is finished without an answer.
    """
    state = questions.select("question_id", "question", F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("final_answer"), F.lit(False).alias("finished"))
    for number in range(1, max_steps + 1):
        active = state.where("not finished").withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.array_join("steps", "\n"), F.lit(f"Step {number}:")))
        if max_length is not None:
            full = length(F.col("prompt")) >= max_length - MARGIN
            closed = active.where(full).drop("prompt").withColumn("finished", F.lit(True))
            state = state.where("finished").unionByName(closed)
            active = active.where(~full)
        step = generated(active, "prompt", model).withColumn("text", own_step(F.col("response"), F.lit(number)))
        step = step.withColumn("a", action_of(F.col("text"))).withColumn("input", F.col("a.input"))
        step = retriever(step) if retriever else step.withColumn("observation", F.lit(None).cast("string"))
        grown = F.concat("steps", F.array(F.concat_ws("\n", "text", F.when(F.col("a.action") == "search", F.col("observation")))))
        over = F.coalesce(F.col("a.action") == "finish", F.lit(False))
        done = step.select("question_id", "question", grown.alias("steps"), F.when(over, F.coalesce("input", F.lit(""))).alias("final_answer"), over.alias("finished"))
        state = store(state.where("finished").unionByName(done), "generation")
        if state.where("not finished").isEmpty():
            break
    return state


def regenerated(truncated: DataFrame, model: Callable[[], TextModel], max_steps: int = 10) -> DataFrame:
    """New endings for trajectories (trajectory_id, question, good_steps) cut before their bad step."""
    start = truncated.select(F.concat("trajectory_id", F.lit("_regen")).alias("question_id"), F.concat_ws("\n", "question", F.array_join("good_steps", "\n")).alias("question"), F.size("good_steps").alias("kept"))
    grown = generation_loop(start.select("question_id", "question"), model, max_steps=max_steps)
    joined = grown.join(start.select("question_id", "kept"), "question_id")
    room = F.greatest(F.lit(0), F.lit(max_steps) - F.col("kept"))
    return joined.select(F.col("question_id").alias("trajectory_id"), "kept", F.slice("steps", F.lit(1), room).alias("new_steps"), "final_answer")


REGISTRY: dict[str, Callable[..., object]] = {"replay": ReplayModel, "hashed_bag": HashedBagEmbedder, "overlap": OverlapScorer, "overlap_steps": OverlapStepScorer}


def create(name: str, **options: object) -> object:
    """A registered model by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name}")
    return REGISTRY[name](**options)
