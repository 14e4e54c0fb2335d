"""Problem 9: long stretches that documents have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.spans import SharedSpans
from steploom.sources import read_table


def _spans(spark: SparkSession, sf_dir: str) -> SharedSpans:
    return SharedSpans(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a stretch in common, also where thousands of texts share it."""
    return _spans(spark, sf_dir).pairs("doc_id_a", "doc_id_b", whole=True)


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the code points, and the share of them, found in other documents."""
    documents = read_table(spark, sf_dir, "documents")
    covered = _spans(spark, sf_dir).covered().withColumnRenamed("doc", "doc_id")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = documents.select("doc_id", n.alias("n_chars")).join(covered, "doc_id", "left")
    shared = F.coalesce("shared", F.lit(0))
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_share"))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text (of 100 code points or more) is repeated, with their class."""
    return _spans(spark, sf_dir).copies().withColumnRenamed("doc", "doc_id")


def p9_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a stretch in common with thousands of others, with its class."""
    return _spans(spark, sf_dir).crowds().withColumnRenamed("doc", "doc_id")


QUERIES = {"p9_found": p9_found, "p9_shared": p9_shared, "p9_copies": p9_copies, "p9_crowds": p9_crowds}
_SHARED = """
with stretches as (select doc_id, i, substr(text, i, 100) as s from (select doc_id, text, unnest(range(1, length(text) - 98)) as i from documents where length(text) >= 100)),
many as (select s from stretches group by s having count(distinct doc_id) > 1),
hits as (select doc_id, i, s from stretches join many using (s))
"""
SQL = {
    "p9_found": _SHARED + "select distinct x.doc_id as doc_id_a, y.doc_id as doc_id_b from hits x join hits y using (s) where x.doc_id < y.doc_id",
    "p9_shared": _SHARED + """, covered as (
  select doc_id, sum(least(100, coalesce(next - i, 100))) as c from (select distinct doc_id, i, lead(i) over (partition by doc_id order by i) as next from (select distinct doc_id, i from hits)) group by doc_id)
select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, cast(coalesce(c, 0) as bigint) as shared_chars,
  case when length(text) > 0 then round(coalesce(c, 0) / length(text), 6) else 0.0 end as shared_share from documents left join covered using (doc_id)""",
    "p9_copies": """
select doc_id, min(doc_id) over (partition by text) as class_id, count(*) over (partition by text) as copies
from documents where length(text) >= 100 qualify count(*) over (partition by text) > 1""",
}
