"""Queries that write tables, read them again and use what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import evaluation, retrieval
from steploom.plans import views
from steploom.plans.q_search import SQL as SEARCH_SQL
from steploom.plans.storage import shared_dir
from steploom.sources import files, read_table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/steploom/trip-{uuid.uuid4().hex}"


def scan_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories written as JSON lines and read with their aliases resolved."""
    path = _folder(spark)
    t = read_table(spark, sf_dir, "trajectories").where("trajectory_id is not null and question is not null")
    files.write_rows(t.select("trajectory_id", "question", F.col("gold_answer").alias("answer"), F.col("final_answer").alias("predicted_answer"), "is_correct", "supporting_facts"), path, "jsonl")
    schema = "trajectory_id string, question string, answer string, predicted_answer string, is_correct boolean, supporting_facts array<string>"
    rows = files.schemas.normalised_trajectories(files.read_json_rows(spark, path, schema))
    return rows.select("trajectory_id", "question", "gold_answer", "final_answer", "is_correct", F.size("supporting_facts").alias("n_facts"))


_TRAJECTORIES_SQL = "select trajectory_id, question, gold_answer, final_answer, is_correct, cast(len(supporting_facts) as integer) as n_facts from trajectories where trajectory_id is not null and question is not null"


def scan_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written and read again: root, next id, nodes and nodes that can still grow."""
    path = _folder(spark)
    files.write_trees(views.tree(spark, sf_dir), path)
    return files.read_trees(spark, path, 2, 4)[1]


_TREES_SQL = f"""with {views.TREE_SQL}, k as (select question_id, parent_id as id, count(*) as c from nodes where parent_id is not null group by 1, 2)
select question_id, 0 as root, max(id) + 1 as next_id, count(*) as n_nodes, count(*) filter (where not is_terminal and coalesce(c, 0) < 2 and depth < 4) as n_expandable from nodes left join k using (question_id, id) group by 1"""


def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written and read again."""
    path = _folder(spark)
    e = read_table(spark, sf_dir, "embeddings")
    files.write_vectors(e, path, "vec_id", "embedding")
    v = files.read_vectors(spark, path, e.count())
    return v.select("vec_id", F.size("embedding").alias("width"), F.round(retrieval.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"))


_VECTORS_SQL = "select vec_id, cast(len(embedding) as integer) as width, round(list_dot_product(cast(embedding as double[]), cast(embedding as double[])), 4) as squared from embeddings"


def bm25_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 search over an index that was saved and opened."""
    path = _folder(spark)
    retrieval.Bm25Index.build(read_table(spark, sf_dir, "documents"), "doc_id", "text").save(path)
    p = read_table(spark, sf_dir, "preference_pairs").where("pair_id % 20 = 0")
    return retrieval.Bm25Index.open(spark, path).search(p, "pair_id", "prompt", 5).select("query_id", "doc_id", "score", "rank")


def evaluate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and cover of the final answers per split."""
    t = read_table(spark, sf_dir, "trajectories")
    return evaluation.evaluate(t, "final_answer", "gold_answer", ["split"], ("em", "cover_phrase"))


def _full(x: str) -> str:
    return views.sql_full(f"case {x} when 'True' then 'yes' when 'False' then 'no' else {x} end")


_EVALUATE_SQL = f"""with n as (select split, final_answer, {_full('final_answer')} as p, {_full('gold_answer')} as g from trajectories where gold_answer is not null)
select split, count(*) as n, count(final_answer) as n_answered, round(100 * avg(coalesce(cast(p = g as integer), 0)), 6) as em,
  round(100 * avg(coalesce(cast(case when g in ('yes', 'no', 'noanswer') or p in ('yes', 'no', 'noanswer') then p = g else contains(p, g) end as integer), 0)), 6) as cover_phrase from n group by split"""

QUERIES = {"scan_trajectories": scan_trajectories, "scan_trees": scan_trees, "scan_vectors": scan_vectors, "bm25_reopened": bm25_reopened, "evaluate_splits": evaluate_splits}
SQL = {"scan_trajectories": _TRAJECTORIES_SQL, "scan_trees": _TREES_SQL, "scan_vectors": _VECTORS_SQL, "bm25_reopened": SEARCH_SQL["bm25_topk"], "evaluate_splits": _EVALUATE_SQL}
