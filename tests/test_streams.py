"""Streams over several micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from steploom.streaming import pipelines


def stream(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return pipelines.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)


def test_update_results_keep_keys_of_earlier_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", "visit", 0.0), ("b", "visit", 0.0)], [("a", "score", 2.0)]], "k string, kind string, v double")
    got = pipelines.run_to_end(pipelines.corrected_values(s, "k", "kind", "v"), "update", keys=["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 1, 2.0), ("b", 1, 0.0)}
    with pytest.raises(ValueError, match="keys"):
        pipelines.run_to_end(s, "update")


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[(at(1), "x", 1.0)], [(at(0.5), "x", 1.0), (at(6), "x", 1.0)], [(at(12), "x", 1.0)], [(at(0.7), "x", 9.0)]]
    s = stream(spark, tmp_path, batches, "t timestamp, k string, v double")
    got = pipelines.run_to_end(pipelines.windowed_counts(s, "t", "k", "v", "1 hour", "2 hours"))
    # the row of 0:42 comes when its window has been closed; the last window is still open
    assert [(r.start.hour, r.n, r.total) for r in got.orderBy("start").collect()] == [(0, 1, 1.0), (1, 1, 1.0), (6, 1, 1.0)]


def test_average_goes_on_across_batches_and_nulls_keep_it(spark, tmp_path):
    s = stream(spark, tmp_path, [[(2, "x", 4.0), (1, "x", 2.0)], [(3, "x", None), (4, "x", 1.0)]], "i int, k string, v double")
    got = pipelines.run_to_end(pipelines.streaming_ema(s, "k", "i", "v", 0.5), "update", keys=["k"]).collect()
    assert [tuple(r) for r in got] == [("x", 4, pytest.approx(0.5 * (0.5 * 1.0 + 2.0) + 0.5))]


def test_arrivals_repeat_the_first_batch(spark):
    rows = spark.range(90).withColumn("v", F.col("id") * 2)
    path, files = pipelines.arrivals(rows, F.col("id"), 3, repeated=True)
    assert files >= 1 and spark.read.parquet(path).count() == 120 and spark.read.parquet(path).distinct().count() == 90


def test_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = pipelines.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], "k string, v double").schema, 1)
    assert pipelines.run_to_end(pipelines.running_totals(s, "k", "v"), "update", keys=["k"]).count() == 0
