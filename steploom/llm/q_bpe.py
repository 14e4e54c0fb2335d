"""Problem 7: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steploom.llm.bpe import encode_text
from steploom.sources import read_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_text(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
