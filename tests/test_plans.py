"""Plans: what must stay in the JVM does, top-k is pruned before its shuffle, scans read what is used."""

import re

import pytest
from pyspark.sql import functions as F

from steploom.operators import losses, retrieval
from steploom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
IN_JVM = (
    "vote_leaderboard vote_details answer_f1 answer_em_cover metrics_multi_gold parse_sections parse_open_ended parse_action parse_numbered_steps judge_json critic_output soft_score step_to_text format_prompt chat_messages extract_answer "
    "consensus_steps consensus_trajectories agreement_kappa training_samples mc_rpe take_until_bad truncate_first_bad classify_questions difficulty_class dpo_best_vs_all dpo_all_margins resume_anti_join tree_paths tree_backprop tree_ucb_select "
    "sibling_pairs doc_spans label_mask kto_loss dpo_loss loss_history scaling_fit gold_in_docs token_length_profile normalize_n1"
).split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_JVM)
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|MapInArrow", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", IN_JVM)
def test_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))


def test_top_k_is_pruned_before_the_shuffle(spark):
    hits = spark.range(1000).select(F.pmod("id", F.lit(7)).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    text = plan(retrieval.top_k(hits, 3))
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["loss_history"](spark, SF))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["event_id:bigint,user_id:bigint,value:double"]
    assert "critic_step_scores" not in plan(QUERIES["vote_majority"](spark, SF))


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["kto_loss"](spark, SF)) + plan(QUERIES["dpo_loss"](spark, SF))
    assert "IsNotNull(chosen_f1)" in re.findall(r"PushedFilters: \[(.*?)\]", text)[-1]


def test_loss_kinds(spark):
    kinds = {k: losses.dpo_loss(F.lit(3.0), F.lit(1.0), 0.5, k).alias(k) for k in ("sigmoid", "ipo", "hinge", "robust")}
    row = spark.range(1).select(*kinds.values()).first()
    assert (row.ipo, row.hinge) == (1.0, 0.0) and 0 < row.robust < row.sigmoid
    with pytest.raises(ValueError):
        losses.dpo_loss(F.lit(1.0), F.lit(1.0), kind="none")
