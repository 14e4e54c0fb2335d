"""Growing search trees: descent by UCB, rollouts with batched models, regeneration from failures.

The state is a node table. Every round handles all questions at once: the children to descend to are
aggregates, the new nodes of all questions go to the models in batches, and the round's table is
stored so that rounds don't pile up lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.answers import f1_reward
from steploom.functions.parse import sections_open
from steploom.operators.models import TextModel, generated
from steploom.operators.tree import ancestors, ucb
from steploom.plans.storage import store

STATE = "question_id string, question string, gold string, id int, parent_id int, depth int, text string, is_terminal boolean, visit_count long, total_value double, f1 double, critic int, scored boolean"


def roots(questions: DataFrame) -> DataFrame:
    """A tree of one node for every question (question_id, question, gold)."""
    return questions.select(
        "question_id", "question", "gold", F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("is_terminal"),
        F.lit(0).cast("long").alias("visit_count"), F.lit(0.0).alias("total_value"), F.lit(None).cast("double").alias("f1"), F.lit(None).cast("int").alias("critic"), F.lit(True).alias("scored"),
    )


def descend(nodes: DataFrame, max_children: int = 2, max_depth: int = 7, c: float = 1.414) -> DataFrame:
    """(question_id, id): the node each tree is to be grown at.

    From the root: a terminal node or one that isn't full stops; else the first unvisited child, or
    the child of highest UCB, the first of equals. ``max_depth`` rounds of joins, one a level.
    """
    kids = nodes.where("parent_id is not null").groupBy("question_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    facts = nodes.select("question_id", "id", "parent_id", "is_terminal", "visit_count", "total_value").join(kids, ["question_id", "id"], "left")
    facts = facts.withColumn("stops", F.col("is_terminal") | (F.coalesce("n_children", F.lit(0)) < max_children))
    parents = facts.select("question_id", F.col("id").alias("parent_id"), F.col("visit_count").alias("n"))
    value = F.when(F.col("visit_count") == 0, F.lit(float("inf"))).otherwise(ucb(F.col("total_value"), F.col("visit_count"), F.col("n"), c))
    best = F.max(F.struct(value.alias("v"), (-F.col("id")).alias("first")))
    chosen = facts.where("parent_id is not null").join(parents, ["question_id", "parent_id"]).groupBy("question_id", "parent_id").agg((-best["first"]).alias("next"))
    stops = facts.select("question_id", "id", "stops")
    at = nodes.where("parent_id is null").select("question_id", "id")
    for _ in range(max_depth):
        here = at.join(stops, ["question_id", "id"]).join(chosen.withColumnRenamed("parent_id", "id"), ["question_id", "id"], "left")
        at = here.select("question_id", F.when(F.col("stops") | F.col("next").isNull(), F.col("id")).otherwise(F.col("next")).alias("id"))
    return at


def prefix_texts(nodes: DataFrame, max_depth: int = 7) -> DataFrame:
    """(question_id, id, prefix): the texts from the root to each node."""
    up = ancestors(nodes, max_depth)
    texts = nodes.select("question_id", F.col("id").alias("ancestor"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "text")))
    joined = up.join(texts, ["question_id", "ancestor"]).groupBy("question_id", "id").agg(ordered.alias("t"))
    return joined.select("question_id", "id", F.array_join(F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != ""), "\n").alias("prefix"))


def add_values(nodes: DataFrame, values: DataFrame, max_depth: int = 7) -> DataFrame:
    """``nodes`` after ``values`` (question_id, id, value, visit) went up to the roots."""
    up = ancestors(nodes, max_depth).join(values, ["question_id", "id"]).groupBy("question_id", F.col("ancestor").alias("id")).agg(F.sum("value").alias("v"), F.sum("visit").alias("n"))
    joined = nodes.join(up, ["question_id", "id"], "left")
    return joined.withColumn("visit_count", F.col("visit_count") + F.coalesce("n", F.lit(0))).withColumn("total_value", F.col("total_value") + F.coalesce("v", F.lit(0.0))).drop("v", "n").select(*nodes.columns)


def grow(
    questions: DataFrame, model: Callable[[], TextModel], critic: Callable[[DataFrame], DataFrame] | None = None, rollouts: int = 8, max_children: int = 2, max_depth: int = 4, beta: float = 0.9, critic_every: int = 4
) -> DataFrame:
    """Trees after ``rollouts`` rounds of select, generate and back-propagate.

    An answer ends a path with its F1 times ``beta`` to the depth. Other new nodes count a visit at once
    and bring their value later: every ``critic_every`` rounds the critic (rows with ``text`` to
    rows with ``score``) rates the nodes still waiting, and only values go up then.
    """
    state = store(roots(questions), "trees")
    for number in range(1, rollouts + 1):
        open_ = descend(state, max_children, max_depth).join(state, ["question_id", "id"])
        growing = open_.where(~F.col("is_terminal") & (F.col("depth") < max_depth)).join(prefix_texts(state, max_depth), ["question_id", "id"])
        ids = state.groupBy("question_id").agg((F.max("id") + 1).alias("new_id"))
        prompt = F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), "prefix", F.concat(F.lit("Sample "), F.lit(number).cast("string")))
        made = generated(growing.join(ids, "question_id").withColumn("prompt", prompt), "prompt", model).withColumn("p", sections_open(F.col("response")))
        filled = made.where("p.think <> '' or p.search <> '' or p.answer <> ''")
        answered = F.col("p.answer") != ""
        ends = answered | (F.col("depth") + 1 >= max_depth)
        f1 = F.when(answered, F.coalesce(f1_reward(F.col("p.answer"), F.col("gold")), F.lit(0.0))).when(ends, 0.0)
        new = filled.select(
            "question_id", "question", "gold", F.col("new_id").alias("id"), F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit("<think>"), "response").alias("text"), ends.alias("is_terminal"),
            F.lit(0).cast("long").alias("visit_count"), F.lit(0.0).alias("total_value"), f1.alias("f1"), F.lit(None).cast("int").alias("critic"), ends.alias("scored"),
        )
        new = store(new, "new-nodes")
        repeats = open_.where(F.col("is_terminal")).select("question_id", "id", (F.coalesce("f1", F.lit(0.0)) * F.pow(F.lit(beta), F.col("depth"))).alias("value"), F.lit(1).alias("visit"))
        fresh = new.select("question_id", "id", (F.coalesce("f1", F.lit(0.0)) * F.pow(F.lit(beta), F.col("depth"))).alias("value"), F.lit(1).alias("visit"))
        state = store(add_values(state.unionByName(new), fresh.unionByName(repeats), max_depth), "trees")
        if critic and (number % critic_every == 0 or number == rollouts):  # no node is left unrated in the end
            state = rated_by(state, critic, beta, max_depth)
    return state


def rated_by(state: DataFrame, critic: Callable[[DataFrame], DataFrame], beta: float, max_depth: int) -> DataFrame:
    """The trees after the critic has rated the nodes still waiting; values go up, visits don't count again."""
    rated = store(critic(state.where("not scored and depth > 0")).select("question_id", "id", F.col("score").cast("int").alias("score"), "depth"), "critic")
    late = rated.select("question_id", "id", (F.col("score") * F.pow(F.lit(beta), F.col("depth"))).alias("value"), F.lit(0).alias("visit"))
    known = state.join(rated.select("question_id", "id", F.col("score").alias("s")), ["question_id", "id"], "left")
    known = known.withColumn("critic", F.coalesce("s", "critic")).withColumn("scored", F.col("scored") | F.col("s").isNotNull()).drop("s").select(*state.columns)
    return store(add_values(known, late, max_depth), "trees")


def regenerate(state: DataFrame, targets: DataFrame, model: Callable[[], TextModel], samples: int = 3, max_depth: int = 7) -> DataFrame:
    """New children (several samples) for the parents of failing nodes, added to the trees.

    ``targets``: question_id, bad_id, feedback. Every sample's prompt carries the feedback, cut to 500
    characters.
    """
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("bad_id")) - 1
    bad = targets.select("question_id", F.col("bad_id").alias("id"), "feedback", place.alias("place")).join(state, ["question_id", "id"])
    at = bad.select("question_id", F.coalesce("parent_id", "id").alias("at"), "feedback", "place").join(state.withColumnRenamed("id", "at"), ["question_id", "at"])
    at = at.join(prefix_texts(state, max_depth).withColumnRenamed("id", "at"), ["question_id", "at"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    prompt = F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), "prefix", F.concat(F.lit("A critic said: "), F.substring(F.coalesce("feedback", F.lit("")), 1, 500)), F.concat(F.lit("Try another step, sample "), F.col("k").cast("string")))
    ids = state.groupBy("question_id").agg(F.max("id").alias("top"))
    made = generated(at.join(ids, "question_id").withColumn("prompt", prompt), "prompt", model).withColumn("p", sections_open(F.col("response")))
    return state.unionByName(_new_nodes(made, F.col("top") + F.col("place") * samples + F.col("k"), F.col("at")))


def regenerate_frontier(
    state: DataFrame, targets: DataFrame, model: Callable[[], TextModel], critic: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3, samples: int = 3, max_depth: int = 7, beta: float = 0.9
) -> DataFrame:
    """Trees regenerated from ``targets`` (question_id, bad_id, feedback) for several rounds.

    The first round samples new children for the parents of failing nodes. Those of its children that
    search and answer nothing are the next round's frontier and get children of their own, until a
    round leaves none. New answers' rewards and the critic's ratings go up to the roots.
    """
    before, frontier = state, None
    for number in range(rounds):
        if number == 0:
            grown = regenerate(before, targets, model, samples, max_depth)
        else:
            grown = _children(before, frontier, model, samples, max_depth, number)
        grown = store(grown, "regenerated")
        new = store(grown.join(before.select("question_id", "id"), ["question_id", "id"], "left_anti"), "new-nodes")
        values = new.select("question_id", "id", (F.coalesce("f1", F.lit(0.0)) * F.pow(F.lit(beta), F.col("depth"))).alias("value"), F.lit(1).alias("visit"))
        before = store(add_values(grown, values, max_depth + rounds), "trees")
        if critic:
            before = rated_by(before, critic, beta, max_depth + rounds)
        searching = F.col("text").contains("<search>") & ~F.col("is_terminal") & (F.col("depth") < max_depth)
        frontier = new.where(searching).select("question_id", "id")
        if frontier.isEmpty():
            break
    return before


def _children(state: DataFrame, frontier: DataFrame, model: Callable[[], TextModel], samples: int, max_depth: int, number: int) -> DataFrame:
    """``state`` with ``samples`` children for every node of the frontier."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("id")) - 1
    at = frontier.withColumn("place", place).join(state, ["question_id", "id"]).join(prefix_texts(state, max_depth), ["question_id", "id"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    prompt = F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), "prefix", F.concat(F.lit(f"Go on, round {number}, sample "), F.col("k").cast("string")))
    ids = state.groupBy("question_id").agg(F.max("id").alias("top"))
    made = generated(at.join(ids, "question_id").withColumn("prompt", prompt), "prompt", model).withColumn("p", sections_open(F.col("response")))
    return state.unionByName(_new_nodes(made, F.col("top") + F.col("place") * samples + F.col("k"), F.col("id")))


def _new_nodes(made: DataFrame, new_id: Column, parent: Column) -> DataFrame:
    """Nodes from responses ``p`` to the prompts of rows with question_id, question, gold and the parent's depth."""
    answered = F.col("p.answer") != ""
    return made.select(
        "question_id", "question", "gold", new_id.cast("int").alias("id"), parent.alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit("<think>"), "response").alias("text"), answered.alias("is_terminal"),
        F.lit(0).cast("long").alias("visit_count"), F.lit(0.0).alias("total_value"), F.when(answered, F.coalesce(f1_reward(F.col("p.answer"), F.col("gold")), F.lit(0.0))).alias("f1"), F.lit(None).cast("int").alias("critic"), answered.alias("scored"),
    )
