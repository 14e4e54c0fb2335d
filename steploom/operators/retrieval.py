"""Ranking passages: BM25 over an inverted index, vector search, fusion, re-ranking.

Hit lists are tables (query_id, doc_id, score, rank). Ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steploom.functions.text import words
from steploom.plans.storage import store

# The usual constants of Okapi BM25 with a floor for negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def top_k(scored: DataFrame, k: int, score: str = "score", order: list[Column] | None = None) -> DataFrame:
    """The k best documents of every query; Spark prunes to k before it shuffles and sorts."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or [F.col(score).desc(), F.col("doc_id")])))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


QUERY_BLOCK = 4096  # queries that meet a part of the corpus together
PART_TOKENS = 1 << 22  # tokens of a part of the corpus


@dataclass
class Bm25Index:
    """docs (doc_id, t: hashes of its tokens), idf (token, idf) and statistics of the corpus.

    The corpus is searched in parts of about PART_TOKENS tokens. A part turns its documents into postings
    sorted by token, sums the postings of each query with one bin count, and gives its k best, so that no
    token's postings gather in one task and k rows a query and part are shuffled.
    """

    docs: DataFrame
    idf: DataFrame
    mean_length: float
    n_tokens: int

    @classmethod
    def build(cls, corpus: DataFrame, doc: str, text: str) -> Bm25Index:
        """From one pass over the corpus for its tokens and one over these for statistics. A null text has no tokens."""
        hashed = F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w))
        return cls._of(store(corpus.select(F.col(doc).cast("long").alias("doc_id"), hashed.alias("t")), "bm25-docs"))

    @classmethod
    def _of(cls, docs: DataFrame) -> Bm25Index:
        n, mean, total = docs.agg(F.count("*"), F.avg(F.size("t")), F.sum(F.size("t"))).first()
        df = docs.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        raw = store(df.select("token", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "bm25-idf")
        floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
        return cls(docs, raw.select("token", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), mean or 1.0, total or 0)

    def save(self, path: str) -> None:
        """Writes the index; :meth:`open` reads it again without the corpus."""
        self.docs.write.parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls._of(spark.read.parquet(path))

    def search(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        """Hits of every query that shares a token with a document, query tokens counted as often as they occur."""
        spark = self.docs.sparkSession
        asked = queries.select(F.col(query).cast("long").alias("query_id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("w"))
        asked = asked.groupBy("query_id", F.xxhash64("w").alias("token")).agg(F.count("*").alias("times")).join(self.idf, "token")
        asked = asked.groupBy("query_id").agg(F.collect_list(F.struct("token", (F.col("times") * F.col("idf")).alias("weight"))).alias("q"))
        asked = store(asked.select("query_id", "q.token", "q.weight"), "bm25-queries")
        groups = max(1, -(-asked.count() // QUERY_BLOCK))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_tokens // PART_TOKENS))
        cell = F.col("g") * parts + F.col("p")
        left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "query_id", "token", "weight")
        left = left.select(cell.alias("cell"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), F.col("token").alias("t"), F.col("weight").alias("w"))
        right = self.docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "doc_id", "t")
        right = right.select(cell.alias("cell"), F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "t", F.lit(None).cast("array<double>").alias("w"))
        mean = self.mean_length

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, held in _by_cell(batches):
                kind = np.asarray(held["kind"])
                q, d = held.filter(pa.array(kind == 0)), held.filter(pa.array(kind == 1))
                if q.num_rows and d.num_rows:
                    yield from _bm25_part(q, d, mean, k)

        near = left.unionByName(right).repartitionById(parts * groups, "cell").sortWithinPartitions("cell").mapInArrow(search, "query_id long, doc_id long, raw double")
        # ties are settled on the rounded score, as sums differ in their last digits with their order
        return top_k(near.select("query_id", "doc_id", F.round("raw", 6).alias("score")), k)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each cell, of batches that are sorted by it."""
    at, held = None, []
    for batch in batches:
        cell = np.asarray(batch.column(batch.schema.get_field_index("cell")))
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if cell[a] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = cell[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def _bm25_part(q: pa.Table, d: pa.Table, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of ``d`` for every query of ``q``."""
    names = np.asarray(d["id"])
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names = names[order]
    lists = d["t"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    token, owner = np.asarray(lists.flatten()), np.repeat(place, sizes)
    lengths = np.zeros(len(names))
    lengths[place] = sizes
    by = np.lexsort((owner, token))
    token, owner = token[by], owner[by]
    if not len(token):
        return
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]))
    tf = np.diff(np.append(first, len(token))).astype(float)
    token, owner = token[first], owner[first]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
    for query, asked, weights in zip(q["id"].to_pylist(), q["t"], q["w"], strict=True):
        asked, weights = np.asarray(asked.values), np.asarray(weights.values)
        low, high = np.searchsorted(token, asked), np.searchsorted(token, asked, side="right")
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
        scores = np.bincount(owner[at], np.repeat(weights, n) * part[at], len(names))
        hit = np.flatnonzero(np.bincount(owner[at], minlength=len(names)))
        rounded = np.round(scores[hit], 6)
        if len(hit) > k:
            keep = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
            hit, rounded = hit[keep], rounded[keep]
        best = hit[np.lexsort((hit, -rounded))[:k]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query)), pa.array(names[best]), pa.array(scores[best])], ["query_id", "doc_id", "raw"])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The array at length 1 (zeros stay)."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Element-wise mean of the token vectors whose mask is 1; null without any."""
    on = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] == 1)
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(on, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.when(F.size(on) > 0, F.transform(total, lambda x: x / F.size(on)))


BLOCK = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _block_search(both: DataFrame, width: int, k: int, cells: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of every query in every cell it is in.

    ``both`` has (id, v, cell, kind), kind 0 for queries and 1 for documents. A cell's queries are held,
    its documents stream by, as one matrix product a batch.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        for batch in batches:  # sorted by cell, the queries of each first
            cell, kind = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            names, matrix = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            for c in np.unique(cell):
                if c != at:
                    at, ids, vectors = c, [], []
                q, d = (cell == c) & (kind == 0), (cell == c) & (kind == 1)
                if q.any():
                    ids.append(names[q])
                    vectors.append(matrix[q])
                if d.any() and vectors:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    order = np.argsort(names[d], kind="stable")
                    own, scores = names[d][order], np.round(vectors[0] @ matrix[d][order].T, 9)
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[0], top.shape[1])), pa.array(own[top].ravel()), pa.array(np.take_along_axis(scores, top, 1).ravel())], ["query_id", "doc_id", "score"])

    spread = both.repartitionById(cells, "cell") if cells else both.repartition("cell")
    return spread.sortWithinPartitions("cell", "kind").mapInArrow(search, "query_id long, doc_id long, score double")


def _vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    return df.where(F.size(vector) == width).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def dense_top_k(corpus: DataFrame, queries: DataFrame, doc: str, query: str, vector: str, k: int, width: int, parts: int | None = None) -> DataFrame:
    """Exact inner-product search of every query against all documents, in blocks.

    Queries fall into groups of about BLOCK and the corpus into parts; every group meets every part
    once and keeps its k best there, so that k rows a query and part are shuffled for the final choice.
    Rows without a vector of ``width`` numbers are left out on both sides.
    """
    parts = parts or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, rows = _vectors(queries, query, vector, width), _vectors(corpus, doc, vector, width)
    groups = max(1, -(-asked.count() // BLOCK))

    def cells(df: DataFrame, own: str, n_own: int, other: str, n_other: int, kind: int) -> DataFrame:
        spread = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return spread.select("id", "v", (F.col("g") * parts + F.col("p")).alias("cell"), F.lit(kind).alias("kind"))

    near = _block_search(cells(asked, "g", groups, "p", parts, 0).unionByName(cells(rows, "p", parts, "g", groups, 1)), width, k, groups * parts)
    return top_k(near.withColumn("score", F.round("score", 6)), k)


class IvfIndex:
    """Cells of vectors around k-means centroids; a search probes the cells nearest to the query.

    There are about as many cells as the root of the number of rows, MOST_CELLS at most. The centroids are
    fitted on a bounded sample (``sample`` rows by hash order); every row is indexed. How many cells are
    probed is measured: the smallest number that finds ``recall`` of the sample's own neighbours for
    a held-out part of it. A cell of more than BLOCK rows is split by a salt, all of which a query probes.
    """

    MOST_CELLS = 4096

    def __init__(self, corpus: DataFrame, doc: str, vector: str, width: int, cells: int | None = None, sample: int = 20_000, rounds: int = 12, recall: float = 0.97, k: int = 10):
        self.width, self.vector = width, vector
        rows = _vectors(corpus, doc, vector, width)
        n = rows.count()
        picked = rows.orderBy(F.xxhash64("id")).limit(sample).select("v")
        points = np.array([r[0] for r in picked.collect()], dtype=np.float64).reshape(-1, width)
        held, points = points[: len(points) // 10], points[len(points) // 10 :]
        count = min(cells or max(16, round(math.sqrt(n))), self.MOST_CELLS, max(1, len(points)))
        self.centroids = points[:count].copy()
        for _ in range(rounds if len(points) else 0):
            nearest = (points @ self.centroids.T).argmax(1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, nearest, points)
            filled = np.bincount(nearest, minlength=count) > 0
            self.centroids[filled] = sums[filled] / np.maximum(np.linalg.norm(sums[filled], axis=1, keepdims=True), 1e-12)
        self.probe = self._measured_probe(points, held, recall, k)
        self.salts = max(1, -(-n // (max(1, count) * BLOCK)))
        salt = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(self.salts)).cast("int")
        self.rows = store(self._cells(rows, 1).select("id", "v", (F.col("cell") * self.salts + salt).alias("cell")), "ivf-rows")

    def _measured_probe(self, points: np.ndarray, held: np.ndarray, recall: float, k: int) -> int:
        if not len(held) or len(points) <= k:
            return len(self.centroids)
        nearest = (points @ self.centroids.T).argmax(1)
        best = np.argpartition(-(held @ points.T), k, axis=1)[:, :k]
        # the place, among a query's cells, of the cell that each true neighbour lies in
        place = np.argsort(np.argsort(-(held @ self.centroids.T), axis=1, kind="stable"), axis=1)
        depth = np.sort(np.take_along_axis(place, nearest[best], axis=1).ravel())
        return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)))]) + 1

    def save(self, path: str) -> None:
        """Writes rows and centroids; :meth:`open` reads them again."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        kept = [(k, c.tolist(), self.probe, self.salts) for k, c in enumerate(self.centroids)]
        spark.createDataFrame(kept, "cell int, v array<double>, probe int, salts int").write.parquet(f"{path}/centroids")

    @classmethod
    def open(cls, spark: SparkSession, path: str, vector: str) -> IvfIndex:
        index = cls.__new__(cls)
        kept = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        index.centroids = np.array([r.v for r in kept])
        index.width, index.vector, index.probe, index.salts = index.centroids.shape[1], vector, kept[0].probe, kept[0].salts
        index.rows = spark.read.parquet(f"{path}/rows")
        return index

    def _cells(self, rows: DataFrame, probe: int) -> DataFrame:
        centroids, width = self.centroids, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column(1), width) @ centroids.T), axis=1, kind="stable")[:, :probe]
                pick = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

        return rows.mapInArrow(run, "id long, v array<double>, cell int")

    def search(self, queries: DataFrame, query: str, k: int, probe: int | None = None) -> DataFrame:
        """The k best of every query in the cells it probes."""
        near = self._cells(_vectors(queries, query, self.vector, self.width), max(1, min(probe or self.probe, len(self.centroids))))
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt")
        asked = near.select("id", "v", "cell", salts).select("id", "v", (F.col("cell") * self.salts + F.col("salt")).alias("cell"), F.lit(0).alias("kind"))
        found = _block_search(asked.unionByName(self.rows.withColumn("kind", F.lit(1))), self.width, k)
        return top_k(found.withColumn("score", F.round("score", 6)), k)


# What one family of embedding models wants in front of queries and passages.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def prefixed(text: Column, query: bool) -> Column:
    """Text as an embedder with role prefixes wants it; null stays null."""
    return F.concat(F.lit(QUERY_PREFIX if query else PASSAGE_PREFIX), text)


def min_max(hits: DataFrame) -> DataFrame:
    """``hits`` with ``norm``: scores from 0 to 1 within each query; 1 in a list without spread."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def reciprocal_fusion(sparse: DataFrame, dense: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the lists a document is in."""
    both = sparse.select("query_id", "doc_id", "rank").unionByName(dense.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 6).alias("score"))
    return top_k(fused, k)


def weighted_fusion(sparse: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha * sparse + (1 - alpha) * dense of normalised scores; a missing side counts 0."""
    a = min_max(sparse).select("query_id", "doc_id", (F.lit(alpha) * F.col("norm")).alias("part"))
    b = min_max(dense).select("query_id", "doc_id", (F.lit(1 - alpha) * F.col("norm")).alias("part"))
    fused = a.unionByName(b).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(fused, k)


def rerank(hits: DataFrame, rerank_score: Column, k: int) -> DataFrame:
    """The k best of a candidate list by another score, equals in their former order."""
    scored = hits.withColumn("rerank_score", rerank_score)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank"))
    return scored.withColumn("new_rank", place).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def truncated_to_corpus(vectors: DataFrame, n_docs: int) -> DataFrame:
    """Cached vectors cut to the corpus' length; too few of them is an error."""
    n = vectors.count()
    if n < n_docs:
        raise ValueError(f"{n} vectors for {n_docs} documents")
    return vectors.where(F.col("vec_id") < n_docs)
