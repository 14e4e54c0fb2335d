"""Search trees as node tables (question_id, id, parent_id, depth, ...), set by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.plans.storage import store

ROUNDS = 8  # joins of a climb from which on its front is stored


def action_type(search: Column, answer: Column, think: Column) -> Column:
    """Search before Answer before Reason, by what is not empty."""

    def there(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return F.when(there(search), "Search").when(there(answer), "Answer").when(there(think), "Reason").otherwise("Other")


def deepest(nodes: DataFrame, max_depth: int | None = None) -> int:
    """The depth of the deepest node; an error if that is beyond a ``max_depth`` that was promised."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    if max_depth is not None and depth > max_depth:
        raise ValueError(f"a node lies at depth {depth}, beyond max_depth {max_depth}")
    return depth


def ancestors(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(question_id, id, ancestor, distance) of every node, itself included.

    A climb of as many equi-joins on (question_id, id) as the deepest node needs; every ROUNDS of them
    the front is stored. Rows grow with nodes times depth.
    """
    parents = nodes.select("question_id", F.col("id").alias("up"), F.col("parent_id").alias("next"))
    front = nodes.select("question_id", "id", F.col("id").alias("ancestor"), F.col("parent_id").alias("next"), F.lit(0).alias("distance"))
    out = front.select("question_id", "id", "ancestor", "distance")
    for distance in range(1, deepest(nodes, max_depth) + 1):
        step = front.where("next is not null").select("question_id", "id", F.col("next").alias("up"))
        front = step.join(parents, ["question_id", "up"]).select("question_id", "id", F.col("up").alias("ancestor"), "next", F.lit(distance).alias("distance"))
        if distance % ROUNDS == 0:
            front = store(front, "tree-front")
        out = out.unionByName(front.select("question_id", "id", "ancestor", "distance"))
    return out


def paths(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(question_id, id, path): ids from the root to each node."""
    up = ancestors(nodes, max_depth)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor")))
    return up.groupBy("question_id", "id").agg(F.transform(ordered, lambda x: x["ancestor"]).alias("path"))


def backpropagate(nodes: DataFrame, values: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(question_id, id, visits, total_value) after each of ``values`` (question_id, id, value) went up.

    A null value counts as a visit that brings its value later; a correction without a visit is a
    row with ``visit`` 0 if ``values`` has that column.
    """
    visit = F.col("visit") if "visit" in values.columns else F.lit(1)
    up = ancestors(nodes, max_depth).join(values.select("question_id", "id", F.coalesce("value", F.lit(0.0)).alias("value"), visit.alias("visit")), ["question_id", "id"])
    return up.groupBy("question_id", F.col("ancestor").alias("id")).agg(F.sum("visit").alias("visits"), F.sum("value").alias("total_value"))


def ucb(total_value: Column, visits: Column, parent_visits: Column, c: float = 1.414) -> Column:
    """Mean value and exploration bonus; an unvisited child is always preferred."""
    bonus = F.lit(c) * F.sqrt(F.log(F.greatest(parent_visits, F.lit(1))) / visits)
    return F.when(visits == 0, float("inf")).otherwise(total_value / visits + bonus)


def select_children(nodes: DataFrame, c: float = 1.414) -> DataFrame:
    """(question_id, parent_id, id, ucb): the child each parent would descend to, the first of equals."""
    parents = nodes.select("question_id", F.col("id").alias("parent_id"), F.col("visit_count").alias("parent_visits"))
    children = nodes.where("parent_id is not null").join(parents, ["question_id", "parent_id"])
    scored = children.withColumn("ucb", F.round(ucb(F.col("total_value"), F.col("visit_count"), F.col("parent_visits"), c), 9))
    best = F.max(F.struct("ucb", (-F.col("id")).alias("first")))
    return scored.groupBy("question_id", "parent_id").agg(best.alias("b")).select("question_id", "parent_id", (-F.col("b.first")).alias("id"), F.col("b.ucb").alias("ucb"))


def propagate_rewards(nodes: DataFrame, beta: float = 0.9, max_depth: int | None = None) -> DataFrame:
    """(question_id, id, depth, reward): leaves f1 * beta^depth, inner nodes the visit-weighted mean below.

    One aggregate a level from the deepest up; levels above the fourth are cut from the lineage.
    Children without visits are averaged plainly, a node without scored children gets 0.
    """
    base = nodes.select("question_id", "id", "parent_id", "depth", "visit_count", F.when(F.col("is_terminal"), F.coalesce("f1", F.lit(0.0)) * F.pow(F.lit(beta), F.col("depth"))).alias("own"))
    bottom = deepest(nodes, max_depth)
    done = base.where(F.col("depth") == bottom).withColumn("reward", F.coalesce("own", F.lit(0.0)))
    below = done
    for level in range(bottom - 1, -1, -1):
        weighted = F.try_divide(F.sum(F.col("reward") * F.col("visit_count")), F.sum("visit_count"))
        means = below.where("parent_id is not null").groupBy("question_id", F.col("parent_id").alias("id")).agg(F.coalesce(F.when(F.sum("visit_count") > 0, weighted), F.avg("reward")).alias("mean"))
        here = base.where(F.col("depth") == level).join(means, ["question_id", "id"], "left")
        below = here.withColumn("reward", F.coalesce("own", "mean", F.lit(0.0))).drop("mean").select(done.columns)
        if bottom - level > 4:
            below = store(below, "tree-level")
        done = done.unionByName(below)
    return done.select("question_id", "id", "depth", F.round("reward", 9).alias("reward"))


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """Per question: nodes, terminals, depth, leaves' reward (mean, median, max), nodes still to expand."""
    full = F.count_if(~F.col("is_terminal") & (F.col("n_children") < 2))
    return nodes.groupBy("question_id").agg(
        F.count("*").alias("n_nodes"), F.count_if("is_terminal").alias("n_terminal"), F.max("depth").alias("max_depth"), F.round(F.avg("f1"), 6).alias("mean_f1"),
        F.round(F.median("f1"), 6).alias("median_f1"), F.round(F.max("f1"), 6).alias("max_f1"), full.alias("n_expandable"),
    )


def regeneration_targets(nodes: DataFrame, pairs: DataFrame, max_pairs: int = 2, max_depth: int | None = None) -> DataFrame:
    """Where to start again in trees that failed: the best path and its first failing node.

    A question qualifies with at most ``max_pairs`` pairs, no reward above 0 and some feedback. Of its
    root-to-leaf paths the one of highest mean critic score (missing scores 0, the first leaf of
    equals) is taken; the failing node is the first on it with score 0 and feedback, else the last
    with feedback.
    """
    counts = pairs.groupBy("question_id").agg(F.count("*").alias("n_pairs"))
    state = nodes.groupBy("question_id").agg(F.max(F.coalesce("f1", F.lit(0.0))).alias("top"), F.count_if(F.col("feedback").isNotNull()).alias("heard"))
    chosen = state.join(counts, "question_id", "left").where((F.coalesce("n_pairs", F.lit(0)) <= max_pairs) & (F.col("top") <= 0) & (F.col("heard") > 0)).select("question_id")
    own = store(nodes.join(chosen, "question_id", "left_semi"), "failed-trees")
    leaves = own.where("is_terminal").select("question_id", "id")
    up = ancestors(own, max_depth).join(leaves, ["question_id", "id"], "left_semi")
    facts = own.select("question_id", F.col("id").alias("ancestor"), F.col("depth"), F.coalesce("critic", F.lit(0)).alias("score"), F.col("critic"), F.col("feedback"))
    steps = up.join(facts, ["question_id", "ancestor"])
    # before the first scored failure nothing is one; behind it the last feedback is the fallback
    failing = F.min(F.when((F.col("critic") == 0) & F.col("feedback").isNotNull(), F.struct("depth", "ancestor")))
    fallback = F.max(F.when(F.col("feedback").isNotNull(), F.struct("depth", "ancestor")))
    rated = steps.groupBy("question_id", "id").agg(F.avg("score").alias("mean"), failing.alias("bad"), fallback.alias("last"))
    best = rated.groupBy("question_id").agg(F.max(F.struct("mean", (-F.col("id")).alias("first"), F.coalesce("bad", "last").alias("node"))).alias("b"))
    node = F.col("b.node")
    return best.select("question_id", (-F.col("b.first")).alias("leaf_id"), F.round("b.mean", 6).alias("path_score"), node["ancestor"].alias("bad_id"), node["depth"].alias("good_prefix"))


def children_count(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children."""
    w = nodes.where("parent_id is not null").groupBy("question_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return nodes.join(w, ["question_id", "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def depth_first_rank(nodes: DataFrame) -> DataFrame:
    """Nodes with their place among their siblings, from 1."""
    return nodes.withColumn("sibling", F.row_number().over(Window.partitionBy("question_id", "parent_id").orderBy("id")))
