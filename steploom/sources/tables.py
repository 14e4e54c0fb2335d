"""The Parquet tables every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a file or a folder of part files alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
