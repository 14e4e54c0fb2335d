"""Problem 6: train, validation and test splits that keep questions and trajectories together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.columns import carried_question
from steploom.llm.splitting import GroupedSplit
from steploom.sources import read_table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables; a record belongs to its question id and to the one its trajectory id carries."""
    scored = read_table(spark, sf_dir, "scored_trajectories").select(F.lit("scored").alias("record_type"), "trajectory_id", "question_id", "is_correct")
    plain = read_table(spark, sf_dir, "trajectories").select(F.lit("trajectory").alias("record_type"), "trajectory_id", F.lit(None).cast("string").alias("question_id"), "is_correct")
    both = scored.unionByName(plain)
    return both.select("record_type", "trajectory_id", F.col("question_id").alias("entity_a"), carried_question(F.col("trajectory_id")).alias("entity_b"), F.col("is_correct").alias("positive"))


def _split(spark: SparkSession, sf_dir: str) -> GroupedSplit:
    return GroupedSplit(_records(spark, sf_dir), read_table(spark, sf_dir, "split_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two question ids that must share a split, also in the largest components."""
    return _split(spark, sf_dir).linked_pairs("question_id_a", "question_id_b", expand=None)


def p6_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every question id."""
    return _split(spark, sf_dir).assignment().withColumnRenamed("entity", "question_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record; those without any question id go to the largest split."""
    split = _split(spark, sf_dir)
    records = _records(spark, sf_dir).withColumn("entity", F.coalesce("entity_a", "entity_b"))
    rest = F.lit(split.names[0] if split.names else None).cast("string")
    return records.join(split.assignment(), "entity", "left").select("record_type", "trajectory_id", F.col("entity").alias("question_id"), F.coalesce("split", rest).alias("split"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, correct ones and shares of every split against its target."""
    split = _split(spark, sf_dir)
    got = split.entities.join(split.split, "component").groupBy("split").agg(F.sum("n").alias("n_records"), F.sum("g").alias("n_correct"), F.countDistinct("component").alias("n_components"))
    targets = read_table(spark, sf_dir, "split_targets")
    total = split.entities.agg(F.sum("n")).first()[0] or 1
    rows = targets.join(got, targets["split_name"] == got["split"], "left")
    n = F.coalesce("n_records", F.lit(0))
    return rows.select("split_name", "proportion", n.alias("n_records"), F.round(n / F.lit(total), 6).alias("share"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"), F.coalesce("n_components", F.lit(0)).alias("n_components"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split whether its records are within the largest component of its quota and none of its components is in another split."""
    split = _split(spark, sf_dir)
    records = _records(spark, sf_dir).where("entity_a is not null or entity_b is not null")
    place = split.assignment().select("entity", "split")
    a, b = (place.toDF(e, s) for e, s in (("entity_a", "sa"), ("entity_b", "sb")))
    rows = records.join(a, "entity_a", "left").join(b, "entity_b", "left").withColumn("split", F.coalesce("sa", "sb"))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("sa") != F.col("sb"), F.lit(False)).cast("int")).alias("torn"))
    total, largest = split.entities.groupBy("component").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
    targets = read_table(spark, sf_dir, "split_targets")
    joined = targets.join(counts, targets["split_name"] == counts["split"], "left")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("proportion") * F.lit(total or 0)) <= F.lit(largest or 0)
    return joined.select("split_name", "proportion", near.alias("near"), (F.coalesce("torn", F.lit(0)) == 0).alias("whole"))


QUERIES = {"p6_found": p6_found, "p6_questions": p6_questions, "p6_records": p6_records, "p6_shares": p6_shares, "p6_checks": p6_checks}
SQL = {
    "p6_checks": "select split_name, proportion, true as near, true as whole from split_targets",
    "p6_found": """
with recursive rows as (
  select question_id as a, regexp_replace(trajectory_id, '^(.*)_sample_.*$', '\\1', 's') as b from scored_trajectories),
edges as (select distinct a, b from rows where a <> b union select distinct b, a from rows where a <> b),
reach as (
  select a, b from edges
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a)
select distinct a as question_id_a, b as question_id_b from reach where a < b""",
}
