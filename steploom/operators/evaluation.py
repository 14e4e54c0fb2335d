"""Evaluating whole answers over the splits of a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.functions.answers import cover_phrase, cover_tokens, exact_match, f1_full

# A metric takes prediction and gold answer and gives a number or a boolean; more can be registered.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"em": exact_match, "f1": lambda p, g: f1_full(p, g)["f1"], "cover_tokens": cover_tokens, "cover_phrase": cover_phrase}


def evaluate(rows: DataFrame, prediction: str, gold: str, by: list[str], metrics: tuple[str, ...] = ("em", "f1")) -> DataFrame:
    """(by, n, n_answered and each metric in percent) over rows with a gold answer; a missing prediction scores 0."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    known = rows.where(F.col(gold).isNotNull())
    scored = known.select(*by, F.col(prediction).isNotNull().alias("__answered"), *(F.coalesce(METRICS[m](F.col(prediction), F.col(gold)).cast("double"), F.lit(0.0)).alias(m) for m in metrics))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("__answered").alias("n_answered"), *(F.round(100 * F.avg(m), 6).alias(m) for m in metrics))
