"""Search services as a retriever, with the fetching injected, and the registry of retrievers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.functions.text import first_sentences, position_score

log = logging.getLogger("steploom")

# (query, k) -> [(title, text, url)]
Fetch = Callable[[str, int], list[tuple[str, str, str]]]


class FetchedRetriever:
    """Hits of a search service: titles in order, the first sentences of their pages, scores by place.

    ``fetch`` is made once a worker. A query that fails has no hits; the failure is logged.
    """

    def __init__(self, make_fetch: Callable[[], Fetch], sentences: int = 5):
        self.make_fetch, self.sentences = make_fetch, sentences

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, title, text, url, score) for rows (query_id, query)."""
        make = self.make_fetch
        key = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch = make()
            for batch in batches:
                rows = []
                for q, text in zip(batch["query_id"], batch["query"], strict=True):
                    try:
                        found = fetch(text or "", k)[:k]
                    except Exception as error:
                        log.warning("search failed: %s", error)
                        found = []
                    rows += [(q, i, *hit) for i, hit in enumerate(found)]
                yield pd.DataFrame(rows, columns=["query_id", "place", "title", "page", "url"])

        hits = queries.select("query_id", "query").mapInPandas(run, f"query_id {key}, place int, title string, page string, url string")
        return hits.select("query_id", (F.col("place") + 1).alias("rank"), "title", first_sentences(F.col("page"), self.sentences).alias("text"), "url", position_score(F.col("place")).alias("score"))


class TableRetriever:
    """BM25 over a corpus table as a retriever."""

    def __init__(self, corpus: DataFrame, doc: str = "doc_id", text: str = "text"):
        from steploom.operators.retrieval import Bm25Index

        self.index = Bm25Index.build(corpus, doc, text)

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.search(queries, "query_id", "query", k)


RETRIEVERS = {"bm25": TableRetriever, "service": FetchedRetriever}


def create_retriever(kind: str, *args: object, **options: object) -> object:
    """A retriever by name."""
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever {kind}")
    return RETRIEVERS[kind](*args, **options)
