"""Customers with so many orders that their trees are deeper than those of the test tables."""

import datetime
import random

import pytest
from oracle import agree, connect
from pyspark.sql import functions as F

from steploom.operators import tree
from steploom.plans import registry, views

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """Orders of three customers: 100 at random, 300 at random, and 100 of which only the root failed."""
    rng = random.Random(5)
    rows = [(k, c, round(rng.uniform(900, 400000), 2), rng.choice("FOP")) for c, keys in ((1, range(1, 101)), (2, range(201, 501))) for k in keys]
    rows += [(k, 3, 1000.0 * k, "O" if k == 1001 else "F") for k in range(1001, 1101)]
    path = str(tmp_path_factory.mktemp("deep"))
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").coalesce(1)
    df.withColumn("o_orderdate", F.lit(datetime.date(1995, 1, 1))).toPandas().to_parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["tree_paths", "tree_backprop", "tree_retroactive", "regen_targets"])
def test_against_sql(spark, deep, name):
    con = connect(deep)
    assert con.execute(SQL[name]).fetchall()
    agree(spark, con, QUERIES[name], SQL[name], deep)


def test_propagated_rewards_against_recursion(spark, deep):
    nodes = {(r.question_id, r.id): r for r in views.tree(spark, deep).collect()}
    got = {(r.question_id, r.id): r.reward for r in QUERIES["tree_propagate"](spark, deep).collect()}

    def reward(q, i):
        me = nodes[q, i]
        if me.is_terminal:
            return me.f1 * 0.9**me.depth
        kids = [k for k in (2 * i + 1, 2 * i + 2) if (q, k) in nodes]
        return sum(reward(q, k) * nodes[q, k].visit_count for k in kids) / sum(nodes[q, k].visit_count for k in kids)

    assert max(r.depth for r in nodes.values()) == 8 and got.keys() == nodes.keys()
    assert all(got[x] == pytest.approx(reward(*x), abs=1e-8) for x in nodes)


def test_chain_deeper_than_the_stored_rounds_and_broken_promise(spark):
    n = 2 * tree.ROUNDS + 3
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, i) for i in range(n)], "question_id int, id int, parent_id int, depth int")
    assert {r.id: r.path for r in tree.paths(chain).collect()} == {i: list(range(i + 1)) for i in range(n)}
    with pytest.raises(ValueError, match="beyond max_depth 5"):
        tree.paths(chain, 5)
