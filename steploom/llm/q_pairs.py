"""Problem 5: answers that don't serve their prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.pairs import broken_sides
from steploom.llm.profiles import Profiles
from steploom.sources import read_table


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_sides(read_table(spark, sf_dir, "preference_pairs"), "pair_id", "prompt", ["chosen", "rejected"], _profiles(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> Profiles:
    """Profiles of the languages that the documents are labelled with."""
    return Profiles.fit(read_table(spark, sf_dir, "documents"), "text", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select("pair_id", "side", "defect")


def p5_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect type that a side triggers."""
    return _broken(spark, sf_dir).select("pair_id", "side", F.explode("defects").alias("defect"))


def p5_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per source, side and type, with their share of the source's pairs."""
    pairs = read_table(spark, sf_dir, "preference_pairs")
    counts = broken_sides(pairs, "source", "prompt", ["chosen", "rejected"], _profiles(spark, sf_dir)).groupBy("source", "side", "defect").agg(F.count("*").alias("n"))
    totals = pairs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_pairs"))
    joined = counts.join(totals, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("source", "side", "defect", "n", "n_pairs", F.round(F.col("n") / F.col("n_pairs"), 6).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_all": p5_all, "p5_by_source": p5_by_source}
SQL: dict[str, str] = {}
