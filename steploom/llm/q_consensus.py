"""Problem 4: a label per step, agreement and annotator reliability."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.consensus import Consensus
from steploom.sources import read_table

STEP = ["trajectory_id", "step_id"]
WORDS = 24  # hash buckets for the words of a reasoning
MAX_PLACE = 8


_WORD = re.compile(r"[^\W\d_]+")


def verdict(label: Column) -> Column:
    """1 for GOOD, 0 for BAD, null for what names neither."""
    word = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")
    return F.when(word.isin("good", "1"), 1).when(word.isin("bad", "0"), 0)


def step_features(judge: DataFrame) -> tuple[DataFrame, int]:
    """Per step its place, how long its judges' reasonings are, and the shares of their words by hash bucket.

    A rollout's rates are left out: its label is computed from them, so they would count a vote twice.
    A null reasoning has no words. Digits are left out of words, as they name steps and years.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = np.zeros((len(texts), WORDS + 1))
            for row, text in enumerate(texts):
                for word in _WORD.findall((text or "").lower()):
                    k = buckets.get(word)
                    if k is None:
                        if len(buckets) > 1 << 18:
                            buckets.clear()
                        k = buckets[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % WORDS
                    counts[row, k] += 1
                counts[row, WORDS] = np.log1p(len(text or "")) / 5
            counts[:, :WORDS] /= np.maximum(counts[:, :WORDS].sum(1, keepdims=True), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k].copy()) for k in range(WORDS + 1))], [*STEP, *(f"x{k}" for k in range(WORDS + 1))])

    rows = judge.select(*STEP, F.col("reasoning").cast("string").alias("text"))
    keys = ", ".join(f"{k} {judge.schema[k].dataType.simpleString()}" for k in STEP)
    said = rows.mapInArrow(run, keys + "".join(f", x{k} double" for k in range(WORDS + 1)))
    place = F.least(F.coalesce(F.col("step_id").cast("double"), F.lit(0.0)), F.lit(float(MAX_PLACE))) / MAX_PLACE
    x = F.array(F.first(place), *(F.avg(f"x{k}") for k in range(WORDS + 1)))
    return said.groupBy(*STEP).agg(x.alias("x")), WORDS + 2


def _consensus(spark: SparkSession, sf_dir: str) -> Consensus:
    judge, rpe = read_table(spark, sf_dir, "judge_labels"), read_table(spark, sf_dir, "rpe_labels")
    columns = [*STEP, "annotator_id", verdict(F.col("label")).alias("vote"), "confidence", "labelled_at", "ingested_at", "label_id"]
    votes = judge.select(columns).unionByName(rpe.select(columns))
    features, width = step_features(judge)
    return Consensus(votes, STEP, "annotator_id", "vote", ["labelled_at", "ingested_at", "label_id"], features, width, "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().where("consensus = 0").select(*STEP)


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus label, its probability and the agreement of every labelled step."""
    label = F.when(F.col("consensus") == 1, "GOOD").otherwise("BAD")
    return _consensus(spark, sf_dir).labels().select(*STEP, label.alias("label"), F.round("p", 6).alias("p_good"), "n_votes", F.round("agreement", 6).alias("agreement"))


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every annotator."""
    return _consensus(spark, sf_dir).reliability()


QUERIES = {"p4_found": p4_found, "p4_steps": p4_steps, "p4_annotators": p4_annotators}
SQL: dict[str, str] = {}
