"""Queries over search trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import pairs, tree
from steploom.plans import views

T = views.TREE_SQL
LEVELS = 5  # depth to which the SQL of tree_propagate is written out; the queries take theirs from the data
_UP = f"""recursive {T}, up as (select question_id, id, id as ancestor, 0 as distance from nodes
  union all select up.question_id, up.id, n.parent_id, up.distance + 1 from up join nodes n on n.question_id = up.question_id and n.id = up.ancestor where n.parent_id is not null)"""


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the root to every node."""
    p = tree.paths(views.tree(spark, sf_dir))
    return p.select("question_id", "id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_PATHS_SQL = f"with {_UP} select question_id, id, string_agg(cast(ancestor as varchar), '>' order by distance desc) as path from up group by question_id, id"


def tree_backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and value of every node after each leaf's reward went up to the root."""
    n = views.tree(spark, sf_dir)
    out = tree.backpropagate(n, n.where("is_terminal").select("question_id", "id", F.col("f1").alias("value")))
    return out.select("question_id", "id", "visits", F.round("total_value", 6).alias("total_value"))


_BACKPROP_SQL = f"with {_UP} select up.question_id, up.ancestor as id, count(*) as visits, round(sum(coalesce(n.f1, 0)), 6) as total_value from up join nodes n on n.question_id = up.question_id and n.id = up.id where n.is_terminal group by 1, 2"


def tree_retroactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for scores that come after their visit: values without visits, discounted by depth."""
    n = views.tree(spark, sf_dir)
    late = n.where("not is_terminal and critic is not null").select("question_id", "id", (F.col("critic") * F.pow(F.lit(0.9), F.col("depth"))).alias("value"), F.lit(0).alias("visit"))
    out = tree.backpropagate(n, late)
    return out.select("question_id", "id", "visits", F.round("total_value", 6).alias("total_value"))


_RETRO_SQL = f"with {_UP} select up.question_id, up.ancestor as id, cast(0 as bigint) as visits, round(sum(n.critic * power(0.9, n.depth)), 6) as total_value from up join nodes n on n.question_id = up.question_id and n.id = up.id where not n.is_terminal and n.critic is not null group by 1, 2"


def tree_ucb_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child that each node would be left for."""
    return tree.select_children(views.tree(spark, sf_dir))


_UCB_SQL = f"""with {T}, s as (select c.question_id, c.parent_id, c.id, round(c.total_value / c.visit_count + 1.414 * sqrt(ln(greatest(p.visit_count, 1)) / c.visit_count), 9) as ucb from nodes c join nodes p on c.question_id = p.question_id and c.parent_id = p.id)
select question_id, parent_id, id, ucb from (select *, row_number() over (partition by question_id, parent_id order by ucb desc, id) as r from s) where r = 1"""


def tree_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of all nodes from their leaves' up."""
    return tree.propagate_rewards(views.tree(spark, sf_dir))


def _level_sql() -> str:
    ctes = []
    for level in range(LEVELS, -1, -1):
        mean = f"(select question_id, parent_id, sum(reward * visit_count) / sum(visit_count) as mean from l{level + 1} group by 1, 2)" if level < LEVELS else "(select null::bigint as question_id, null::integer as parent_id, null::double as mean where false)"
        ctes.append(f"l{level} as (select n.question_id, n.id, n.parent_id, n.depth, n.visit_count, coalesce(case when n.is_terminal then coalesce(n.f1, 0) * power(0.9, n.depth) end, m.mean, 0) as reward from nodes n left join {mean} m on m.question_id = n.question_id and m.parent_id = n.id where n.depth = {level})")
    union = " union all ".join(f"select question_id, id, depth, round(reward, 9) as reward from l{level}" for level in range(LEVELS + 1))
    return f"with {T}, {', '.join(ctes)} {union}"


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, depth and rewards of every tree."""
    return tree.tree_statistics(tree.children_count(views.tree(spark, sf_dir)))


_TSTATS_SQL = f"""with {T}, k as (select question_id, parent_id, count(*) as n from nodes where parent_id is not null group by 1, 2), c as (select nodes.*, coalesce(k.n, 0) as n_children from nodes left join k on k.question_id = nodes.question_id and k.parent_id = nodes.id)
select question_id, count(*) as n_nodes, count(*) filter (where is_terminal) as n_terminal, max(depth) as max_depth, round(avg(f1), 6) as mean_f1, round(median(f1), 6) as median_f1, round(max(f1), 6) as max_f1, count(*) filter (where not is_terminal and n_children < 2) as n_expandable from c group by question_id"""


def _rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose every node has a reward: leaves their own, inner nodes a fixed fraction of their value."""
    n = views.tree(spark, sf_dir)
    return n.withColumn("f1", F.coalesce("f1", F.round(F.col("total_value") % 1, 6)))


_REWARDED = f"{T}, rewarded as (select * replace (coalesce(f1, round(total_value % 1, 6)) as f1) from nodes), scored as (select *, f1 + coalesce(0.3 * critic, 0) as reward from rewarded where parent_id is not null)"
_PAIRED = f"""{_REWARDED}, paired as (select a.question_id, a.parent_id, a.depth as step_level, case when a.reward > b.reward then a.id else b.id end as chosen_id, case when a.reward > b.reward then b.id else a.id end as rejected_id,
  case when a.reward > b.reward then a.action else b.action end as chosen_action, case when a.reward > b.reward then a.f1 else b.f1 end as chosen_f1, case when a.reward > b.reward then b.f1 else a.f1 end as rejected_f1, abs(a.reward - b.reward) as gap
  from scored a join scored b on a.question_id = b.question_id and a.parent_id = b.parent_id and a.id < b.id and a.text <> b.text where abs(a.reward - b.reward) >= 0.01), pairs as (select * from paired where chosen_action <> 'Other')"""


def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of siblings."""
    p = pairs.sibling_pairs(_rewarded(spark, sf_dir))
    return p.select("question_id", "parent_id", "step_level", "chosen_id", "rejected_id", F.round(F.col("chosen_reward") - F.col("rejected_reward"), 6).alias("gap"))


def sibling_pairs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose chosen side has an F1 of 0.2 and leads by as much."""
    p = pairs.sibling_pairs(_rewarded(spark, sf_dir), min_f1=0.2)
    return p.select("question_id", "parent_id", "chosen_id", "rejected_id")


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and questions per step level."""
    return pairs.pair_statistics(pairs.sibling_pairs(_rewarded(spark, sf_dir)))


def regen_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to start again in trees without any reward."""
    n = views.tree(spark, sf_dir).withColumn("f1", F.when(F.col("f1") >= 0.5, F.col("f1")))
    return tree.regeneration_targets(n, pairs.sibling_pairs(_rewarded(spark, sf_dir)))


_REGEN_SQL = f"""with {_UP}, rewarded as (select * replace (coalesce(f1, round(total_value % 1, 6)) as f1) from nodes), scored as (select *, f1 + coalesce(0.3 * critic, 0) as reward from rewarded where parent_id is not null),
{_PAIRED.split('scored as (select *, f1 + coalesce(0.3 * critic, 0) as reward from rewarded where parent_id is not null), ')[1]},
k as (select question_id, count(*) as n from pairs group by 1), st as (select question_id, max(case when f1 >= 0.5 then f1 else 0 end) as top, count(feedback) as heard from nodes group by 1),
q as (select st.question_id from st left join k using (question_id) where coalesce(n, 0) <= 2 and top <= 0 and heard > 0),
leaf as (select question_id, id from nodes where is_terminal and question_id in (select question_id from q)),
path as (select l.question_id, l.id, u.ancestor, n.depth, coalesce(n.critic, 0) as score, n.critic, n.feedback from leaf l join up u on u.question_id = l.question_id and u.id = l.id join nodes n on n.question_id = u.question_id and n.id = u.ancestor),
r as (select question_id, id, avg(score) as mean, min(depth) filter (where critic = 0 and feedback is not null) as bad, max(depth) filter (where feedback is not null) as last from path group by 1, 2),
b as (select *, row_number() over (partition by question_id order by mean desc, id) as place from r)
select b.question_id, b.id as leaf_id, round(mean, 6) as path_score, p.ancestor as bad_id, p.depth as good_prefix from b left join path p on p.question_id = b.question_id and p.id = b.id and p.depth = coalesce(b.bad, b.last) where b.place = 1"""

QUERIES = {
    "tree_paths": tree_paths, "tree_backprop": tree_backprop, "tree_retroactive": tree_retroactive, "tree_ucb_select": tree_ucb_select, "tree_propagate": tree_propagate, "tree_stats": tree_stats,
    "sibling_pairs": sibling_pairs, "sibling_pairs_strict": sibling_pairs_strict, "pair_stats": pair_stats, "regen_targets": regen_targets,
}
SQL = {
    "tree_paths": _PATHS_SQL, "tree_backprop": _BACKPROP_SQL, "tree_retroactive": _RETRO_SQL, "tree_ucb_select": _UCB_SQL, "tree_propagate": _level_sql(), "tree_stats": _TSTATS_SQL,
    "sibling_pairs": f"with {_PAIRED} select question_id, parent_id, step_level, chosen_id, rejected_id, round(gap, 6) as gap from pairs",
    "sibling_pairs_strict": f"with {_PAIRED} select question_id, parent_id, chosen_id, rejected_id from pairs where chosen_f1 >= 0.2 and chosen_f1 - rejected_f1 >= 0.2",
    "pair_stats": f"with {_PAIRED} select step_level, count(*) as n_pairs, count(distinct question_id) as n_questions from pairs group by step_level",
    "regen_targets": _REGEN_SQL,
}
