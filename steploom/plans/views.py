"""Views of the tables that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.functions.text import question_id_of
from steploom.sources import read_table

# ------------------------------------------------------------------ SQL snippets

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_ARTICLE = r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])"
QID = "regexp_replace(trajectory_id, '^(.*)_sample_.*$', '\\1', 's')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def sql_full(x: str) -> str:
    from steploom.functions.text import ARTICLES, TITLES

    marks = _PUNCT + "´"
    listed = ", ".join(f"'{w}'" for w in [*TITLES, *ARTICLES])
    spaced = f"regexp_replace(translate(lower({x}), '{marks}', '{' ' * (len(marks) - 1)}'), '[\\s\\p{{Z}}]+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({spaced}, ' '), lambda w: w <> '' and w not in ({listed})), ' ')"


def sql_joined(x: str) -> str:
    return sql_squeeze(f"translate(lower({x}), '{_PUNCT}', '')")


def sql_bare(x: str) -> str:
    once = f"regexp_replace(lower({x}), '{_ARTICLE}', '\\1 \\2', 'g')"
    twice = f"regexp_replace({once}, '{_ARTICLE}', '\\1 \\2', 'g')"
    return sql_squeeze(f"translate({twice}, '{_PUNCT}', '')")


def sql_ascii(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_same(p: str, g: str) -> str:
    """Multiset intersection size of two token lists (column names)."""
    return f"coalesce(list_sum(list_transform(list_intersect({p}, {g}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda y: y = t))))), 0)"


VOTES_SQL = f"""
votes as (
  select * exclude (r) from (
    select coalesce(question_id, {QID}) as question_id, trajectory_id, predicted_answer as answer, gold_answer as gold, coalesce(is_correct, false) as is_correct,
           case when critic_min is null or isnan(critic_min) then 0.0 else critic_min end as score, critic_step_scores, critic_step_labels, epoch_us(scored_at) as ord,
           row_number() over (partition by trajectory_id order by scored_at desc, ingested_at desc, coalesce(question_id, {QID}) desc) as r
    from scored_trajectories) where r = 1)"""

STEPS_SQL = """
steps as (
  select * exclude (r) from (
    select *, row_number() over (partition by trajectory_id, step_id order by step_row_id desc) as r from adaptive_steps) where r = 1)"""


def _latest_label(table: str, extra: str = "") -> str:
    return f"""select * exclude (r) from (
    select trajectory_id, step_id, case when v in ('good', '1') then 'GOOD' else 'BAD' end as label, coalesce(confidence, 1.0) as confidence{extra},
           row_number() over (partition by trajectory_id, step_id order by labelled_at desc, label_id desc) as r
    from (select *, lower(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) as v from {table}) where v in ('good', '1', 'bad', '0')) where r = 1"""


LABELS_SQL = f"""
judged as ({_latest_label('judge_labels', ', reasoning')}),
rated as ({_latest_label('rpe_labels', ', mc_s_t, mc_s_t_a_t')}),
labels as (
  select j.trajectory_id, j.step_id, r.label as rpe, j.label as judge, r.confidence as rpe_conf, j.confidence as judge_conf
  from judged j join rated r on j.trajectory_id = r.trajectory_id and j.step_id = r.step_id),
consensus as (
  select *, case when rpe = judge then case when rpe = 'GOOD' then 1 else 0 end end as consensus_label, rpe = judge as is_consensus,
         case when rpe = judge then least(rpe_conf, judge_conf) else 0.0 end as confidence, case when rpe <> judge then 'rpe_' || rpe || '_judge_' || judge end as reason
  from labels)"""

TREE_SQL = """
nodes0 as (
  select o_custkey as question_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as id, o_orderkey, o_totalprice, o_orderstatus from orders),
nodes as (
  select question_id, id, case when id > 0 then cast((id - 1) // 2 as integer) end as parent_id, cast(floor(log2(id + 1)) as integer) as depth,
         cast(1 + o_orderkey % 5 as integer) as visit_count, o_totalprice / 1000 as total_value,
         2 * id + 1 > max(id) over (partition by question_id) as is_terminal,
         case when 2 * id + 1 > max(id) over (partition by question_id) then round(o_totalprice % 1.0, 6) end as f1,
         case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as critic, case when o_orderkey % 4 <> 0 then 'note ' || o_orderkey end as feedback,
         'text ' || (o_orderkey % 7) as text, case when o_orderkey % 3 = 0 then 'Search' when o_orderkey % 3 = 1 then 'Answer' else 'Other' end as action
  from nodes0)"""


# ------------------------------------------------------------------ DataFrames


def votes(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The last scoring of every trajectory: question_id, answer, gold, is_correct, score, ord.

    ``extra`` names further columns to be carried along; arrays that nobody asks for are neither read
    nor shuffled.
    """
    t = read_table(spark, sf_dir, "scored_trajectories")
    q = F.coalesce("question_id", question_id_of(F.col("trajectory_id")))
    score = F.when(F.col("critic_min").isNull() | F.isnan("critic_min"), 0.0).otherwise(F.col("critic_min"))
    rows = t.select(
        "trajectory_id", q.alias("question_id"), F.col("predicted_answer").alias("answer"), F.col("gold_answer").alias("gold"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
        score.alias("score"), *extra, F.unix_micros(F.col("scored_at").cast("timestamp")).alias("ord"), "scored_at", "ingested_at",
    )
    others = ["question_id", "answer", "gold", "is_correct", "score", *extra, "ord"]
    last = F.max_by(F.struct(*others), F.struct("scored_at", "ingested_at", "question_id"))
    return rows.groupBy("trajectory_id").agg(last.alias("r")).select("trajectory_id", "r.*")


def golds(votes: DataFrame) -> DataFrame:
    """(question_id, gold): the gold answer of each question's first attempt that has one."""
    return votes.where("gold is not null").groupBy("question_id").agg(F.min_by("gold", F.struct("ord", "trajectory_id")).alias("gold"))


GOLDS_SQL = "golds as (select question_id, arg_min(gold, ord) as gold from votes where gold is not null group by question_id)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every step."""
    t = read_table(spark, sf_dir, "adaptive_steps")
    others = [c for c in t.columns if c not in ("trajectory_id", "step_id")]
    last = F.max_by(F.struct(*others), "step_row_id")
    return t.groupBy("trajectory_id", "step_id").agg(last.alias("r")).select("trajectory_id", "step_id", "r.*")


def _latest(t: DataFrame, *extra: str) -> DataFrame:
    word = F.lower(F.regexp_replace("label", "[^A-Za-z0-9]", ""))
    rows = t.withColumn("v", word).where(F.col("v").isin("good", "1", "bad", "0"))
    value = F.struct(F.when(F.col("v").isin("good", "1"), "GOOD").otherwise("BAD").alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *extra)
    return rows.groupBy("trajectory_id", "step_id").agg(F.max_by(value, F.struct("labelled_at", "label_id")).alias("r")).select("trajectory_id", "step_id", "r.*")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest valid judge label of every step."""
    return _latest(read_table(spark, sf_dir, "judge_labels"), "reasoning")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest valid rollout label of every step."""
    return _latest(read_table(spark, sf_dir, "rpe_labels"), "mc_s_t", "mc_s_t_a_t")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that both labelled: rpe, judge and their confidences."""
    r = rated(spark, sf_dir).select("trajectory_id", "step_id", F.col("label").alias("rpe"), F.col("confidence").alias("rpe_conf"))
    j = judged(spark, sf_dir).select("trajectory_id", "step_id", F.col("label").alias("judge"), F.col("confidence").alias("judge_conf"))
    return j.join(r, ["trajectory_id", "step_id"])


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary search tree per customer, its nodes made from the customer's orders in order."""
    from pyspark.sql import Window

    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    n = o.select(F.col("o_custkey").alias("question_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("id"), "o_orderkey", "o_totalprice", "o_orderstatus")
    last = F.max("id").over(Window.partitionBy("question_id"))
    leaf: Column = 2 * F.col("id") + 1 > last
    status = F.col("o_orderstatus")
    return n.select(
        "question_id", "id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2).cast("int")).alias("parent_id"), (F.length(F.bin(F.col("id") + 1)) - 1).alias("depth"),
        (1 + key % 5).cast("int").alias("visit_count"), (F.col("o_totalprice") / 1000).alias("total_value"), leaf.alias("is_terminal"),
        F.when(leaf, F.round(F.col("o_totalprice") % 1.0, 6)).alias("f1"), F.when(status == "F", 1).when(status == "O", 0).alias("critic"),
        F.when(key % 4 != 0, F.concat(F.lit("note "), key.cast("string"))).alias("feedback"), F.concat(F.lit("text "), (key % 7).cast("string")).alias("text"),
        F.when(key % 3 == 0, "Search").when(key % 3 == 1, "Answer").otherwise("Other").alias("action"),
    )
