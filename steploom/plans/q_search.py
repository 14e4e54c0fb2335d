"""Queries over retrieval: BM25, vector search, fusion and re-ranking.

Queries are every row whose id is divisible by 20, searched against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import retrieval
from steploom.operators.models import OverlapScorer, pair_scored
from steploom.plans.storage import store
from steploom.sources import read_table
from steploom.sources.files import with_ordinal

WIDTH = 64
NEAREST = 50  # length of the lists that are fused


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 20 = 0")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for the prompts of every twentieth pair."""
    d = read_table(spark, sf_dir, "documents")
    p = read_table(spark, sf_dir, "preference_pairs").where("pair_id % 20 = 0")
    index = retrieval.Bm25Index.build(d, "doc_id", "text")
    hits = index.search(p, "pair_id", "prompt", 5)
    return hits.select("query_id", "doc_id", "score", "rank")


_T = "list_filter(string_split_regex(lower(coalesce({}, '')), '[\\s\\p{{Z}}\\x{{0085}}\\x{{001C}}-\\x{{001F}}]+'), lambda w: w <> '')"
_BM25_SQL = f"""with d as (select doc_id, {_T.format('text')} as t from documents), n as (select count(*) as n, avg(len(t)) as mean from d),
p as (select doc_id, token, any_value(length) as length, count(*) as tf from (select doc_id, len(t) as length, unnest(t) as token from d) group by doc_id, token),
raw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select token, count(*) as df from p group by token), n),
idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select query_id, token, count(*) as times from (select pair_id as query_id, unnest({_T.format('prompt')}) as token from preference_pairs where pair_id % 20 = 0) group by 1, 2),
s as (select query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from q join idf using (token) join p using (token), n group by query_id, doc_id)
select query_id, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 5"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of highest inner product for every twentieth vector."""
    e, q = _embeddings(spark, sf_dir)
    return retrieval.dense_top_k(e, q, "vec_id", "vec_id", "embedding", 10, WIDTH).select("query_id", "doc_id", "score", "rank")


_DENSE = """s as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_dot_product(cast(q.embedding as double[]), cast(d.embedding as double[])), 6) as score from embeddings q, embeddings d where q.vec_id % 20 = 0),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= {k})"""
_DENSE_SQL = f"with {_DENSE.format(k=10)} select query_id, doc_id, score, cast(rank as integer) as rank from dense"


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over the cells nearest to each query."""
    e, q = _embeddings(spark, sf_dir)
    return retrieval.IvfIndex(e, "vec_id", "embedding", WIDTH).search(q, "vec_id", 10).select("query_id", "doc_id", "score", "rank")


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cell search finds 95 in a hundred of the exact hits, in one row."""
    exact, found = dense_topk(spark, sf_dir).select("query_id", "doc_id"), ivf_topk(spark, sf_dir).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count("*").alias("n"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.95).alias("recalled"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A dense list of 50, and a sparse one by label distance and id distance."""
    e, q = _embeddings(spark, sf_dir)
    dense = retrieval.dense_top_k(e, q, "vec_id", "vec_id", "embedding", NEAREST, WIDTH)
    # the nearest ids of a label are its neighbours by place, so blocks of places meet, never a whole label
    placed = with_ordinal(e.select("vec_id", "label"), "label", "vec_id").select(F.col("vec_id").alias("doc_id"), "label", "ord", F.floor(F.col("ord") / NEAREST).alias("block"))
    asked = placed.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql"), F.col("ord").alias("qo"), F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    same = asked.join(placed, "block").where((F.col("ql") == F.col("label")) & (F.abs(F.col("qo") - F.col("ord")) <= NEAREST))
    sparse = retrieval.top_k(same.select("query_id", "doc_id", F.round(1 / (1 + F.abs(F.col("query_id") - F.col("doc_id"))), 6).alias("score")), NEAREST)
    return sparse, dense


_LISTS = f"""{_DENSE.format(k=50)}, m as (select q.vec_id as query_id, d.vec_id as doc_id, round(1 / (1 + abs(q.vec_id - d.vec_id)), 6) as score from embeddings q join embeddings d on q.label = d.label where q.vec_id % 20 = 0),
sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m) where rank <= 50)"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused by reciprocal ranks."""
    sparse, dense = _lists(spark, sf_dir)
    return retrieval.reciprocal_fusion(sparse, dense, 10).select("query_id", "doc_id", "score", "rank")


_RRF_SQL = f"""with {_LISTS}, f as (select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score from (select query_id, doc_id, rank from sparse union all select query_id, doc_id, rank from dense) group by 1, 2)
select query_id, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 10"""


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused by their normalised scores."""
    sparse, dense = _lists(spark, sf_dir)
    return retrieval.weighted_fusion(sparse, dense, 10, 0.4).select("query_id", "doc_id", "score", "rank")


_NORM = "case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end"
_WEIGHTED_SQL = f"""with {_LISTS}, f as (select query_id, doc_id, round(sum(part), 6) as score from (
  select query_id, doc_id, 0.4 * {_NORM} as part from sparse window w as (partition by query_id) union all select query_id, doc_id, 0.6 * {_NORM} as part from dense window w as (partition by query_id)) group by 1, 2)
select query_id, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 10"""


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates ordered anew by the difference of their labels' and ids' parity."""
    sparse, dense = _lists(spark, sf_dir)
    fused = retrieval.reciprocal_fusion(sparse, dense, 20)
    score = F.lit(0.0) - F.abs(F.col("doc_id") - F.col("query_id")).cast("double") % 7
    return retrieval.rerank(fused, score, 5).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


_RERANK_SQL = f"""with {_LISTS}, f as (select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score from (select query_id, doc_id, rank from sparse union all select query_id, doc_id, rank from dense) group by 1, 2),
c as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 20)
select query_id, doc_id, cast(s as double) + 0.0 as rerank_score, cast(r as integer) as rank from (select *, -(abs(doc_id - query_id) % 7) as s, row_number() over (partition by query_id order by -(abs(doc_id - query_id) % 7) desc, rank) as r from c) where r <= 5"""


def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits ordered anew by a pair model (the word-overlap stand-in)."""
    hits = store(bm25_topk(spark, sf_dir), "hits")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    p = read_table(spark, sf_dir, "preference_pairs").select(F.col("pair_id").alias("query_id"), "prompt")
    scored = pair_scored(hits.join(d, "doc_id").join(p, "query_id"), "prompt", "text", OverlapScorer)
    return retrieval.rerank(scored, F.round("rerank_score", 6), 3).select("query_id", "doc_id", "rerank_score", "rank")


def cosine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the mean vector of its label."""
    e, _ = _embeddings(spark, sf_dir)
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(means, "label").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("mean")), 5).alias("cosine"))


_COSINE_SQL = """with p as (select label, i, avg(cast(x as double)) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2),
m as (select label, list(m order by i) as mean from p group by label) select vec_id, round(list_cosine_similarity(cast(embedding as double[]), mean), 5) as cosine from embeddings join m using (label)"""

QUERIES = {
    "bm25_topk": bm25_topk, "dense_topk": dense_topk, "ivf_topk": ivf_topk, "ivf_recall": ivf_recall, "rrf_fusion": rrf_fusion, "weighted_fusion": weighted_fusion,
    "hybrid_rerank": hybrid_rerank, "model_rerank": model_rerank, "cosine_labels": cosine_labels,
}
_RECALL_SQL = f"with {_DENSE.format(k=10)} select count(*) as n, true as recalled from dense"

SQL = {"ivf_recall": _RECALL_SQL, "bm25_topk": _BM25_SQL, "dense_topk": _DENSE_SQL, "rrf_fusion": _RRF_SQL, "weighted_fusion": _WEIGHTED_SQL, "hybrid_rerank": _RERANK_SQL, "cosine_labels": _COSINE_SQL}
