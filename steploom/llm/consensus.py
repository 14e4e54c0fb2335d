"""Consensus of annotators' binary labels with a feature-assisted prior.

A regularised logistic classifier over item features and a confusion matrix for every annotator
are fitted jointly by expectation-maximisation. The E-step weighs an item's votes by the matrices,
with the classifier's output as the label prior; the M-step re-estimates the matrices from expected
counts and moves the classifier by one Newton step towards the expected labels. An annotator whose
votes are mostly reversed counts in reverse, one who guesses counts for nothing.

Confidences are calibrated rather than believed: an annotator has a matrix for each band of the own
confidences (lower, middle and upper third, or none given), drawn towards the annotator's matrix by
CALIBRATION votes. Where high confidence goes with no better votes, the bands come out alike and the
confidence has no weight, whatever its scale.

A round is one pass over a stored table with a row an item; what comes back to the driver is one
number for each parameter (and pair of feature weights), summed in the cluster.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.plans.storage import store

ROUNDS = 60  # beyond these a warning says how far the parameters still moved
TOLERANCE = 1e-4
PENALTY = 1.0  # L2 on the feature weights, the intercept aside
PRIOR = 1.0  # pseudo-votes in each cell of a confusion matrix
BANDS = 4  # of an annotator's confidences: none, and the thirds of those given
CALIBRATION = 100.0  # votes of either kind by which a band is drawn towards its annotator


@dataclass
class Model:
    """``right[k, c]``: probability of a vote k where k is true (k: 0 or 1), for annotator and band ``c``.

    ``whole`` has the same for annotators over all their bands.
    """

    right: np.ndarray
    weights: np.ndarray
    whole: np.ndarray

    def posterior(self, item: np.ndarray, who: np.ndarray, vote: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(prior, posterior) probability of label 1 of every item, from its votes and features."""
        prior = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        up = np.log(self.right[1] / (1 - self.right[0]))
        down = np.log((1 - self.right[1]) / self.right[0])
        score = np.log(prior / (1 - prior)) + np.bincount(item, np.where(vote == 1, up[who], down[who]), len(x))
        return prior, 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    """(item, annotator, vote, features) of a batch by its code, vote and feature columns."""
    who, votes, x = (batch.column(batch.schema.get_field_index(c)) for c in ("__codes", "__votes", "__features"))
    size = np.asarray(pc.list_value_length(who)).astype(np.int64)
    item = np.repeat(np.arange(len(size)), size)
    return item, np.asarray(who.flatten()), np.asarray(votes.flatten()), np.asarray(x.flatten(), dtype=float).reshape(-1, features)


class Consensus:
    """Consensus over ``votes`` (item columns ``keys``, annotator, vote, and ``order`` columns).

    ``vote`` is 1, 0 or null (no vote). Of several rows of an annotator on an item only the last by
    ``order`` counts; if that is no vote, the annotator has none there. Repeated rows therefore
    change nothing. A row with a null key or annotator is no vote, an item without votes has no
    consensus. ``features`` (keys and an array ``x`` of ``width`` doubles) may miss items, whose
    features are then 0; without it the prior is one number. ``confidence`` names a column of numbers
    on any scale, null or NaN where there is none. The number of annotators is taken to fit the
    driver; nothing else is.
    """

    def __init__(self, votes: DataFrame, keys: list[str], annotator: str, vote: str, order: list[str], features: DataFrame | None = None, width: int = 0, confidence: str | None = None):
        self.keys = keys
        named = F.lit(True)
        for k in [*keys, annotator]:
            named = named & F.col(k).isNotNull()
        sure = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
        last = F.max(F.struct(*order, F.col(vote).cast("int").alias("__vote"), F.when(~F.isnan(sure), sure).alias("__sure")))
        latest = votes.where(named).groupBy(*keys, F.col(annotator).alias("__who")).agg(last.alias("__last"))
        latest = store(latest.select(*keys, "__who", "__last.__vote", "__last.__sure").where("__vote is not null"), "latest-votes")
        known = latest.groupBy("__who").agg(F.percentile_approx("__sure", [1 / 3, 2 / 3], 1000).alias("cuts")).orderBy("__who").collect()
        self.annotators = [r[0] for r in known]
        codes = latest.sparkSession.createDataFrame([(r[0], k, r.cuts) for k, r in enumerate(known)], "__who string, __number int, __cuts array<double>")
        band = F.when(F.col("__sure").isNull(), 0).otherwise(1 + F.size(F.filter("__cuts", lambda c: c < F.col("__sure"))))
        coded = latest.join(codes, "__who").withColumn("__code", F.col("__number") * BANDS + band)
        pairs = F.array_sort(F.collect_list(F.struct("__code", "__vote")))
        items = coded.groupBy(*keys).agg(pairs.alias("__v"))
        self.width = width + 1
        x = F.array(F.lit(1.0))
        if features is not None:
            items = items.join(features.select(*keys, F.col("x").alias("__x")), keys, "left")
            x = F.concat(x, F.coalesce("__x", F.array_repeat(F.lit(0.0), width)))
        items = items.select(*keys, F.col("__v.__code").alias("__codes"), F.col("__v.__vote").alias("__votes"), x.alias("__features"))
        self.items = store(items, "items")
        self.rounds = 0
        self.model = self._fit()

    def _totals(self, model: Model | None) -> np.ndarray:
        """Sums over all items of one E-step: expected confusion counts, gradient, curvature, size."""
        a, d = BANDS * len(self.annotators), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 * a + d + d * d + 2)
            for batch in batches:
                item, who, vote, x = _columns(batch, d)
                n = len(x)
                if model is None:
                    prior = np.full(n, 0.5)
                    p = (np.bincount(item, vote, n) + 0.5) / (np.bincount(item, minlength=n) + 1)
                else:
                    prior, p = model.posterior(item, who, vote, x)
                for cell, (weight, cast) in enumerate(((p, 1), (p, 0), (1 - p, 1), (1 - p, 0))):
                    total[cell * a : (cell + 1) * a] += np.bincount(who, weight[item] * (vote == cast), a)
                total[4 * a : 4 * a + d] += x.T @ (p - prior)
                total[4 * a + d : 4 * a + d + d * d] += ((x * (prior * (1 - prior))[:, None]).T @ x).ravel()
                total[-2:] += n, p.sum()
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["k", "v"])

        summed = self.items.select("__codes", "__votes", "__features").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(4 * a + d + d * d + 2)
        for r in summed:
            out[r.k] = r.v
        return out

    def _step(self, totals: np.ndarray, weights: np.ndarray) -> Model:
        a, d = BANDS * len(self.annotators), self.width
        cells = totals[: 4 * a].reshape(4, a)
        rates = lambda c: np.stack([c[3] / (c[2] + c[3]), c[0] / (c[0] + c[1])])
        whole = np.clip(rates(cells.reshape(4, -1, BANDS).sum(2) + PRIOR), 1e-4, 1 - 1e-4)
        own = np.repeat(whole, BANDS, axis=1)
        right = rates(cells + CALIBRATION * np.stack([own[1], 1 - own[1], 1 - own[0], own[0]]))
        ridge = np.full(d, PENALTY)
        ridge[0] = 1e-6
        curve = totals[4 * a + d : -2].reshape(d, d) + np.diag(ridge)
        move = np.linalg.solve(curve, totals[4 * a : 4 * a + d] - ridge * weights)
        return Model(np.clip(right, 1e-4, 1 - 1e-4), weights + np.clip(move, -2, 2), whole)

    def _fit(self) -> Model:
        weights = np.zeros(self.width)
        if not self.annotators:
            return Model(np.zeros((2, 0)), weights, np.zeros((2, 0)))
        model = self._step(self._totals(None), weights)
        for self.rounds in range(1, ROUNDS + 1):
            new = self._step(self._totals(model), model.weights)
            change = max(np.abs(new.right - model.right).max(), np.abs(new.weights - model.weights).max())
            model = new
            if change < TOLERANCE:
                return model
        warnings.warn(f"consensus not settled after {ROUNDS} rounds: the last moved a parameter by {change:.2g}", stacklevel=3)
        return model

    def labels(self) -> DataFrame:
        """Keys, consensus (1 or 0; 1 at a tie), p (of label 1), n_votes, agreement (share of votes equal to it)."""
        model, d = self.model, self.width
        fields = [self.items.schema[k] for k in self.keys]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, who, vote, x = _columns(batch, d)
                p = model.posterior(item, who, vote, x)[1]
                label = (p >= 0.5).astype(np.int32)
                n = np.bincount(item, minlength=len(x))
                agree = np.bincount(item, vote == label[item], len(x)) / np.maximum(n, 1)
                kept = [batch.column(k) for k in range(len(fields))]
                made = [pa.array(label), pa.array(p), pa.array(n.astype(np.int32)), pa.array(agree)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*self_keys, "consensus", "p", "n_votes", "agreement"])

        self_keys = list(self.keys)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return self.items.mapInArrow(run, f"{schema}, consensus int, p double, n_votes int, agreement double")

    def reliability(self) -> DataFrame:
        """annotator, n_votes, right_1, right_0 (confusion diagonal), reliability in [-1, 1] (negative: reversed), calibration.

        ``calibration`` is how much more reliable the upper third of the own confidences is than the lower.
        """
        spark = self.items.sparkSession
        schema = "annotator string, right_1 double, right_0 double, reliability double, calibration double"
        bands = self.model.right.sum(0).reshape(-1, BANDS)
        rows = [(name, float(g), float(b), float(g + b - 1), float(x[3] - x[1])) for name, b, g, x in zip(self.annotators, *self.model.whole, bands, strict=True)]
        counts = self.items.select(F.explode("__codes").alias("c")).withColumn("c", F.floor(F.col("c") / BANDS).cast("int")).groupBy("c").agg(F.count("*").alias("n_votes"))
        codes = spark.createDataFrame(list(zip(self.annotators, range(len(self.annotators)), strict=True)), "annotator string, c int")
        return spark.createDataFrame(rows, schema).join(codes, "annotator").join(counts, "c").select("annotator", "n_votes", "right_1", "right_0", "reliability", "calibration")
