"""Problem 8: documents mixed to the target shares of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.bpe import count_tokens
from steploom.llm.mixing import Mix
from steploom.plans.storage import store
from steploom.sources import read_table


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "source", "text")
    return store(count_tokens(rows, "text", ["record", "source"]), "tokens")


def _mix(spark: SparkSession, sf_dir: str, **options) -> Mix:
    return Mix(_counted(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), **options)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used when every source meets its target share exactly."""
    return _mix(spark, sf_dir).passes().withColumnRenamed("record", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of that mix."""
    return _mix(spark, sf_dir).shares()


def _budgeted(spark: SparkSession, sf_dir: str) -> Mix:
    """A mix of 0.7 times the corpus: more than the targets can fill, so the exponent is bisected to the repetition limits."""
    counted = _counted(spark, sf_dir)
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    return Mix(counted, read_table(spark, sf_dir, "mix_targets"), budget=0.7 * total)


def p8_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in a mix of 0.7 times the corpus."""
    return _budgeted(spark, sf_dir).passes().withColumnRenamed("record", "doc_id")


def p8_shares_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix of 0.7 times the corpus: tempered as far as the repetition limits ask for."""
    return _budgeted(spark, sf_dir).shares()


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source whether the repetition limit is kept and the weight met to within one record; an exponent above 0 is tempered."""
    counted = _counted(spark, sf_dir)
    targets = read_table(spark, sf_dir, "mix_targets")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    largest = counted.groupBy(F.col("source").alias("s")).agg(F.max("n_tokens").alias("largest"))
    out = None
    for name, options in (("targets", {}), ("budget", {"budget": 0.7 * total}), ("entropy", {"wanted_entropy": 1.8})):
        mix = Mix(counted, targets, **options)
        rows = mix.shares().join(largest, F.col("source") == F.col("s"), "left")
        met = F.abs(F.col("tokens_drawn") - F.col("weight") * F.lit(float(mix.budget))) <= F.coalesce("largest", F.lit(0)) + 1e-6 * F.lit(float(mix.budget))
        rows = rows.select(F.lit(name).alias("mix"), "source", (F.col("most_passes") <= F.col("max_passes")).alias("kept"), met.alias("met"), F.lit(mix.exponent > 0).alias("tempered"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p8_shares_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix tempered to an entropy of 1.8 nats, targets aside."""
    return _mix(spark, sf_dir, wanted_entropy=1.8).shares()


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_mix_budget": p8_mix_budget, "p8_checks": p8_checks, "p8_shares_budget": p8_shares_budget, "p8_shares_entropy": p8_shares_entropy}
SQL = {
    "p8_checks": "select mix, source, true as kept, true as met, mix <> 'targets' as tempered from mix_targets, (values ('targets'), ('budget'), ('entropy')) as m(mix)",
}
