"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.plans.storage import store, superseded


def _joined(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest partner of u. Aggregated before it is joined, so a
    node with very many partners is neither collected nor grouped."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Partners above a node are linked to the smallest node around it."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    out = _joined(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its partners below it are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _joined(down)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (two columns); the component is its smallest node.

    Null ends and loops are left out: a node without another partner isn't listed. Each round is
    stored, and the last is the one that changes nothing; the number of rounds grows with the
    logarithm of the number of nodes.
    """
    a, b = edges.columns
    at = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where("u <> v")
    at = store(at.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        before, at = at, store(_small_star(_large_star(at)), "stars")
        superseded(before)
        new = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v").distinct())
