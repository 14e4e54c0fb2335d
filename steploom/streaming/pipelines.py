"""Incremental pipelines in Structured Streaming.

Sources are folders of Parquet files read with a fixed schema; every query is run with
``availableNow`` and a checkpoint folder, so that a restart goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from steploom.plans.storage import is_stored, shared_dir


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, in the order they appear."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def arrivals(rows: DataFrame, order: Column, batches: int, repeated: bool = False) -> tuple[str, int]:
    """``rows`` written as files that arrive in ``batches`` by ``order``: (folder, files a batch).

    With ``repeated`` the first batch is delivered once more at the end. Within a batch the rows are in
    no order.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/steploom/arrivals-{uuid.uuid4().hex}"
    marked = rows.withColumn("__at", order.cast("double"))
    shares = [k / batches for k in range(1, batches)]
    cuts = marked.agg(F.percentile_approx("__at", shares, 10_000)).first()[0] or [0.0] * len(shares)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.coalesce("__at", F.lit(float("-inf")))))
    for k in [*range(batches), *([0] if repeated else [])]:
        # each append is later than the one before, which is the order a file stream goes by
        marked.where(part == k).drop("__at").write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return path, max(1, files // (batches + repeated))


def run_to_end(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """All results of a stream over what is there now, as a table.

    Append results go to Parquet files with their own commit log. Of complete results the last batch
    stays. Update results need their ``keys``: every batch is kept by its number, a batch that is
    run again replaces itself, and the latest row of every key is the result.
    """
    spark = stream.sparkSession
    base = checkpoint or f"{shared_dir(spark)}/steploom/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    if mode == "update" and not keys:
        raise ValueError("update results are merged by their keys")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "update" else out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not is_stored(spark, out):  # nothing has come yet
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(out)
    every = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return latest.select(*(F.col("__last")[c].alias(c) if c in rest else F.col(c) for c in stream.columns))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of every id; ids are remembered for ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Rows and summed values per key and event-time window, closed by the watermark."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = stream.withWatermark(time, delay).groupBy(window.alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions per key: runs of rows no more than ``gap`` apart."""
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Totals so far per key (complete or update mode)."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def each_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a batch function over what is there now; a batch number seen before is a repeat."""
    stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def corrected_values(stream: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """Visits now, values later: per key the visits and the value known so far.

    A "visit" row counts at once with a provisional value of 0; a "score" row corrects the value
    afterwards and counts no visit.
    """
    schema = T.StructType([stream.schema[key], T.StructField("visits", T.LongType()), T.StructField("total", T.DoubleType())])

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        visits, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            visits += int((pdf[kind] == "visit").sum())
            total += float(pdf.loc[pdf[kind] == "score", value].sum())
        state.update((visits, total))
        yield pd.DataFrame([(*name, visits, total)], columns=[f.name for f in schema])

    return stream.groupBy(key).applyInPandasWithState(fold, schema, "visits long, total double", "update", GroupStateTimeout.NoTimeout)


def streaming_ema(stream: DataFrame, key: str, order: str, value: str, decay: float = 0.1) -> DataFrame:
    """The exponential average of a metric log per run, kept across batches; rows of a batch by ``order``.

    A row may come before rows of an earlier batch by ``order``: the average and the weight of what
    came so far are kept with the last ``order``, rows are added in the order of their batches.
    """
    schema = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("ema", T.DoubleType())])

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat([b[[order, value]] for b in batches]).sort_values(order)
        x = rows[value].to_numpy(dtype=float)
        known = x[~np.isnan(x)]
        # closed form: the last value weighs ``decay``, each before it 1 - decay times the next
        ema = float(ema * (1 - decay) ** len(known) + decay * (known * (1 - decay) ** np.arange(len(known) - 1, -1, -1)).sum())
        state.update((n + len(x), ema))
        yield pd.DataFrame([(*name, n + len(x), ema)], columns=[f.name for f in schema])

    return stream.groupBy(key).applyInPandasWithState(fold, schema, "n long, ema double", "update", GroupStateTimeout.NoTimeout)
