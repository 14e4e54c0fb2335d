"""Queries over labels, votes, outcome classes and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import classify, labeling, pairs, training_rows, voting
from steploom.plans import views
from steploom.sources import read_table

V, G, L, S = views.VOTES_SQL, views.GOLDS_SQL, views.LABELS_SQL, views.STEPS_SQL


# ------------------------------------------------------------------ votes


def _vote(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = voting.chosen_by(views.votes(spark, sf_dir), method)
        return out.select("question_id", "answer", F.round("value", 6).alias("value"))

    return run


_KEYED = "keyed as (select question_id, lower(trim(answer)) as key, count(*) as n, sum(score) as weight, min(ord) as first, arg_min(answer, ord) as answer from votes where coalesce(trim(answer), '') <> '' group by 1, 2)"


def _vote_cte(method: str) -> str:
    if method == "best_of_n":
        return "select question_id, answer, score as value from (select *, row_number() over (partition by question_id order by score desc, ord) as r from votes) where r = 1"
    by = "cast(n as double)" if method == "majority" else "weight"
    order = "n" if method == "majority" else "round(weight, 9)"
    return f"select question_id, answer, {by} as value from (select *, row_number() over (partition by question_id order by {order} desc, first) as r from keyed) where r = 1"


def _vote_sql(method: str) -> str:
    return f"with {V}, {_KEYED} select question_id, answer, round(value, 6) as value from ({_vote_cte(method)})"


def vote_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of each way to choose an answer."""
    v = views.votes(spark, sf_dir)
    return voting.leaderboard(v, views.golds(v))


_BARE_P, _BARE_G = views.sql_bare("answer"), views.sql_bare("gold")
_BOARD_SQL = f"""with {V}, {G}, {_KEYED},
chosen as (select 'majority' as method, * from ({_vote_cte('majority')}) union all select 'weighted', * from ({_vote_cte('weighted')}) union all select 'best_of_n', * from ({_vote_cte('best_of_n')})),
j as (select method, answer, gold, coalesce(contains(lower(trim(answer)), lower(trim(gold))), false) as ok, {views.sql_tokens(_BARE_P)} as p, {views.sql_tokens(_BARE_G)} as g from chosen join golds using (question_id)),
s as (select *, {views.sql_same('p', 'g')} as same from j)
select method, count(*) as total, cast(sum(cast(ok as integer)) as bigint) as correct, round(100 * avg(cast(ok as integer)), 6) as em,
  round(100 * avg(case when same = 0 or p is null then 0.0 else 2.0 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) end), 6) as f1 from s group by method"""


def vote_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of every step scoring with every way to vote."""
    v = views.votes(spark, sf_dir, "critic_step_scores")
    known = F.filter(F.coalesce("critic_step_scores", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    return voting.scoring_grid(v.withColumn("critic_step_scores", known), views.golds(v), "critic_step_scores")


_GRID_SQL = f"""with {V}, {G},
a as (select question_id, ord, answer, list_filter(coalesce(critic_step_scores, cast([] as double[])), lambda x: x is not null and not isnan(x)) as s from votes),
w as (select question_id, ord, answer, 'min' as scoring, round(coalesce(list_min(s), 0.0), 6) as score from a union all select question_id, ord, answer, 'product', round(case when len(s) = 0 then 0.0 else list_product(s) end, 6) from a
  union all select question_id, ord, answer, 'avg', round(coalesce(list_avg(s), 0.0), 6) from a),
k as (select scoring, question_id, lower(trim(answer)) as key, count(*) as n, sum(score) as weight, min(ord) as ord, arg_min(answer, ord) as answer from w where trim(coalesce(answer, '')) <> '' group by 1, 2, 3),
chosen as (select scoring, 'majority' as method, question_id, answer from (select *, row_number() over (partition by scoring, question_id order by n desc, ord) as r from k) where r = 1
  union all select scoring, 'weighted', question_id, answer from (select *, row_number() over (partition by scoring, question_id order by round(weight, 9) desc, ord) as r from k) where r = 1
  union all select scoring, 'best_of_n', question_id, answer from (select *, row_number() over (partition by scoring, question_id order by score desc, ord) as r from w) where r = 1),
j as (select scoring, method, coalesce(contains(lower(trim(answer)), lower(trim(gold))), false) as ok, {views.sql_tokens(_BARE_P)} as p, {views.sql_tokens(_BARE_G)} as g from chosen join golds using (question_id)),
s as (select *, {views.sql_same('p', 'g')} as same from j)
select scoring, method, count(*) as total, cast(sum(cast(ok as integer)) as bigint) as correct, round(100 * avg(cast(ok as integer)), 6) as em,
  round(100 * avg(case when same = 0 or p is null then 0.0 else 2.0 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) end), 6) as f1 from s group by 1, 2"""


def vote_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question the number of attempts and every method's choice."""
    return voting.details(views.votes(spark, sf_dir))


_DETAILS_SQL = f"""with {V}, {_KEYED} select n.question_id, n.n_attempts, a.answer as majority, b.answer as weighted, c.answer as best_of_n
from (select question_id, count(*) as n_attempts from votes group by question_id) n left join ({_vote_cte('majority')}) a using (question_id) left join ({_vote_cte('weighted')}) b using (question_id) left join ({_vote_cte('best_of_n')}) c using (question_id)"""


def step_score_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step scores of each trajectory as minimum, product and mean."""
    v = views.votes(spark, sf_dir, "critic_step_scores")
    s = F.filter(F.coalesce("critic_step_scores", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    return v.select("trajectory_id", *(F.round(voting.step_score(s, m), 6).alias(m) for m in ("min", "product", "avg")))


_AGG_SQL = f"""with {V}, s as (select trajectory_id, list_filter(coalesce(critic_step_scores, cast([] as double[])), lambda x: x is not null and not isnan(x)) as s from votes)
select trajectory_id, round(coalesce(list_min(s), 0.0), 6) as min, round(case when len(s) = 0 then 0.0 else list_product(s) end, 6) as product, round(coalesce(list_avg(s), 0.0), 6) as avg from s"""


# ------------------------------------------------------------------ labels


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.step_consensus(views.labels(spark, sf_dir))


def consensus_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of rollout and judge label for every step that has both."""
    return _consensus(spark, sf_dir).select("trajectory_id", "step_id", "rpe", "judge", "consensus_label", "is_consensus", F.round("confidence", 6).alias("confidence"), "reason")


_CONSENSUS_SQL = f"with {L} select trajectory_id, step_id, rpe, judge, consensus_label, is_consensus, round(confidence, 6) as confidence, reason from consensus"


def consensus_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement per trajectory and whether it is filtered."""
    return labeling.trajectory_consensus(_consensus(spark, sf_dir), "trajectory_id")


_TRAJ_SQL = f"""with {L}, t as (select trajectory_id, count(*) as n_steps, avg(cast(is_consensus as integer)) as rate from consensus group by trajectory_id)
select trajectory_id, n_steps, round(rate, 6) as agreement, rate < 1 as is_filtered, case when rate < 0.8 then 'agreement_rate_too_low_' || printf('%.2f', rate) when rate < 1 then 'trajectory_level_conflict' end as filter_reason from t"""


def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus labels over all steps, in one row."""
    return labeling.consensus_statistics(_consensus(spark, sf_dir))


_STATS_SQL = f"with {L} select count(*) as n_steps, count(*) filter (where consensus_label = 1) as n_good, count(*) filter (where consensus_label = 0) as n_bad, count(*) filter (where consensus_label is null) as n_filtered, round(avg(cast(is_consensus as integer)), 6) as agreement from consensus"


def consensus_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories whose mean consensus confidence is high enough."""
    return labeling.confident(_consensus(spark, sf_dir), "trajectory_id")


_CONFIDENT_SQL = f"with {L} select trajectory_id, round(avg(confidence), 6) as avg_confidence from consensus group by trajectory_id having avg(confidence) >= 0.7"


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.labels(spark, sf_dir).select((F.col("rpe") == "GOOD").cast("long").alias("a"), (F.col("judge") == "GOOD").cast("long").alias("b"))


def agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and kappa of rollout and judge labels."""
    return labeling.agreement_kappa(_binary(spark, sf_dir), "a", "b")


_KAPPA_SQL = f"""with {L}, c as (select count(*) as n, sum(cast(rpe = 'GOOD' and judge = 'GOOD' as integer)) as t, sum(cast(rpe = 'GOOD' as integer)) as l, sum(cast(judge = 'GOOD' as integer)) as r from labels),
p as (select n, (2 * t + n - l - r) / n as po, (l * r + (n - l) * (n - r)) / (n * n) as pe from c) select n, round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa from p"""


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge labels measured against rollout labels."""
    return labeling.label_quality(_binary(spark, sf_dir), "b", "a")


_QUALITY_SQL = f"""with {L}, c as (select count(*) as n, count(*) filter (where rpe = 'GOOD' and judge = 'GOOD') as tp, count(*) filter (where rpe <> 'GOOD' and judge = 'GOOD') as fp, count(*) filter (where rpe = 'GOOD' and judge <> 'GOOD') as fn, count(*) filter (where rpe <> 'GOOD' and judge <> 'GOOD') as tn from labels)
select n, round((tp + tn) / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step with a consensus label and the steps before it."""
    s = views.steps(spark, sf_dir).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_id", F.coalesce("step_type", F.lit("")).alias("t")))).alias("s"))
    c = _consensus(spark, sf_dir).where("consensus_label is not null").select("trajectory_id", "step_id", "consensus_label", "confidence")
    rows = c.join(s, "trajectory_id")
    prefix = F.array_join(F.transform(F.filter("s", lambda x: x["step_id"] < F.col("step_id")), lambda x: x["t"]), ">")
    return rows.select("trajectory_id", "step_id", prefix.alias("prefix"), F.col("consensus_label").alias("label"), F.round("confidence", 6).alias("confidence"))


_SAMPLES_SQL = f"""with {L}, {S}, s as (select trajectory_id from steps group by trajectory_id)
select c.trajectory_id, c.step_id, coalesce((select string_agg(coalesce(p.step_type, ''), '>' order by p.step_id) from steps p where p.trajectory_id = c.trajectory_id and p.step_id < c.step_id), '') as prefix, c.consensus_label as label, round(c.confidence, 6) as confidence
from consensus c join s using (trajectory_id) where c.consensus_label is not null"""


def mc_rpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and label of every step from its success rates before and after."""
    s = views.steps(spark, sf_dir).where("mc_before is not null and mc_after is not null and not isnan(mc_before) and not isnan(mc_after)")
    b, a = F.col("mc_before"), F.col("mc_after")
    return s.select("trajectory_id", "step_id", F.round(labeling.rpe_ratio(b, a), 4).alias("ratio"), labeling.rpe_label(b, a).alias("label"))


_RPE_SQL = f"with {S} select trajectory_id, step_id, round(mc_after / (mc_before + 1e-8), 4) as ratio, case when mc_after / (mc_before + 1e-8) >= 0.5 then 'GOOD' else 'BAD' end as label from steps where mc_before is not null and mc_after is not null and not isnan(mc_before) and not isnan(mc_after)"


def _step_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = views.steps(spark, sf_dir).select("trajectory_id", "step_id", "text", F.concat(F.lit("Q "), "trajectory_id").alias("question"))
    c = _consensus(spark, sf_dir).select("trajectory_id", "step_id", F.col("consensus_label").alias("label"))
    rows = s.where("trajectory_id is not null").join(c, ["trajectory_id", "step_id"], "left")
    return rows, training_rows.step_rows(rows)


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion of every labelled step."""
    return _step_rows(spark, sf_dir)[1].select("trajectory_id", "step_id", "prompt", "completion", "good")


_STEP_ROW_SQL = f"""with {L}, {S} select s.trajectory_id, s.step_id, concat_ws(chr(10), 'Q ' || s.trajectory_id, (select string_agg(coalesce(p.text, ''), chr(10) order by p.step_id nulls first) from steps p where p.trajectory_id = s.trajectory_id and p.step_id < s.step_id)) as prompt,
coalesce(s.text, '') as completion, c.consensus_label = 1 as good from steps s join consensus c on s.trajectory_id = c.trajectory_id and s.step_id = c.step_id where c.consensus_label is not null"""


def step_rows_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the preparation of step rows."""
    rows, made = _step_rows(spark, sf_dir)
    return training_rows.step_counters(rows, made).select("n_steps", "n_kept", "n_skipped", "n_good", "n_bad")


_STEP_ROWS_SQL = f"""with {L}, {S}, j as (select c.consensus_label as label from steps s left join consensus c on s.trajectory_id = c.trajectory_id and s.step_id = c.step_id where s.trajectory_id is not null)
select count(*) as n_steps, count(label) as n_kept, count(*) - count(label) as n_skipped, count(*) filter (where label = 1) as n_good, count(*) filter (where label = 0) as n_bad from j"""


# ------------------------------------------------------------------ classes and samples


def take_until_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step labels of every trajectory up to the first BAD."""
    v = views.votes(spark, sf_dir, "critic_step_labels").where("critic_step_labels is not null")
    kept = classify.take_until_bad(F.col("critic_step_labels"))
    return v.select("trajectory_id", F.array_join(kept.cast("array<string>"), "").alias("labels"), F.size(kept).alias("n_kept"))


_UNTIL_SQL = f"""with {V}, p as (select trajectory_id, critic_step_labels as l, coalesce(nullif(list_position(critic_step_labels, 0), 0), len(critic_step_labels)) as k from votes where critic_step_labels is not null)
select trajectory_id, array_to_string(l[1:k], '') as labels, cast(k as integer) as n_kept from p"""


def truncate_first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each trajectory is cut: before its first BAD step, or its last step without one."""
    v = views.votes(spark, sf_dir, "critic_step_labels", "critic_step_scores").where("size(critic_step_labels) > 0")
    t = classify.truncate_at_bad(F.col("critic_step_labels"), F.col("critic_step_scores"))
    return v.select("trajectory_id", t.alias("t")).select("trajectory_id", "t.n_good", "t.bad_index", F.round("t.bad_score", 6).alias("bad_score"), "t.n_discarded")


_FIRST_BAD_SQL = f"""with {V}, p as (select trajectory_id, critic_step_labels as l, critic_step_scores as s, cast(coalesce(nullif(list_position(critic_step_labels, 0), 0), len(critic_step_labels)) as integer) - 1 as i from votes where len(critic_step_labels) > 0)
select trajectory_id, i as n_good, i as bad_index, round(coalesce(s[i + 1], 0.0), 6) as bad_score, cast(len(l) - i - 1 as integer) as n_discarded from p"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.votes(spark, sf_dir).withColumnRenamed("score", "critic_min")


def classify_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with and without a right attempt, and their best attempt."""
    return classify.classify_questions(_attempts(spark, sf_dir))


_CLASSIFY_SQL = f"""with {V}, g as (select *, first_value(gold) over (partition by question_id order by ord rows between unbounded preceding and unbounded following) as g0 from votes),
n as (select *, lower(trim(answer)) as p, lower(trim(g0)) as g from g), m as (select *, trim(translate(p, '"''“”', '')) as p3, trim(translate(g, '"''“”', '')) as g3 from n),
j as (select *, coalesce((p <> '' and g <> '' and (contains(p, g) or contains(g, p))) or (p3 <> '' and g3 <> '' and (contains(p3, g3) or contains(g3, p3))), false) as ok from m),
b as (select question_id, trajectory_id, row_number() over (partition by question_id order by ok desc, score desc, ord) as r from j)
select j.question_id, case when bool_or(ok) then 'A' else 'B' end as "case", max(b.trajectory_id) as best_trajectory, count(*) filter (where ok) as num_correct, count(*) as num_total from j join b on j.question_id = b.question_id and b.r = 1 group by j.question_id"""


def best_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt of highest score of every question."""
    return classify.best_per_question(_attempts(spark, sf_dir)).select("question_id", "trajectory_id", F.round("critic_min", 6).alias("critic_min"))


_BEST_SQL = f"with {V} select question_id, trajectory_id, round(score, 6) as critic_min from (select *, row_number() over (partition by question_id order by score desc, ord) as r from votes) where r = 1"


def _difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.steps(spark, sf_dir).groupBy("trajectory_id").agg(F.count("*").alias("n_steps"), F.avg(F.when(F.col("mc_after") > 0, F.col("mc_after"))).alias("positive"), F.avg("mc_after").alias("avg_mc"))
    c = _consensus(spark, sf_dir).groupBy("trajectory_id").agg(F.avg(F.col("is_consensus").cast("double")).alias("rate"))
    rows = s.join(c, "trajectory_id", "left")
    d = classify.difficulty(F.coalesce("positive", F.lit(0.0)), F.coalesce("rate", F.lit(1.0)), F.col("n_steps"))
    return rows.select("trajectory_id", "n_steps", F.round("avg_mc", 6).alias("avg_mc"), d.alias("difficulty"))


_DIFF = f"""{L}, {S}, s as (select trajectory_id, count(*) as n_steps, avg(mc_after) filter (where mc_after > 0) as positive, avg(mc_after) as avg_mc from steps group by trajectory_id),
c as (select trajectory_id, avg(cast(is_consensus as integer)) as rate from consensus group by trajectory_id),
d as (select trajectory_id, n_steps, round(avg_mc, 6) as avg_mc, case when coalesce(positive, 0) >= 0.7 then case when coalesce(rate, 1) >= 0.9 then 'easy' else 'medium' end when coalesce(positive, 0) >= 0.3 then 'medium' else 'hard' end as difficulty from s left join c using (trajectory_id))"""


def difficulty_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories, steps and success rates per difficulty."""
    return _difficulties(spark, sf_dir).groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("n_steps"), 6).alias("mean_steps"), F.round(F.avg("avg_mc"), 4).alias("mean_mc"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled per source, 5 of each, by hash order."""
    d = read_table(spark, sf_dir, "documents").where("source is not null")
    names = ("passage_dump", "search_rollouts", "judge_notes", "chat_pairs", "step_logs", "question_bank", "regen_runs", "hand_checked")
    place = classify.hash_place(F.col("doc_id"))
    return classify.stratified_sample(d.select("doc_id", "source"), "source", place, dict.fromkeys(names, 5)).select("source", "doc_id", "place")


_SAMPLE_SQL = "select source, doc_id, cast(place as integer) as place from (select source, doc_id, row_number() over (partition by source order by (doc_id * 2654435761) % 4294967296) as place from documents where source is not null) where place <= 5"


def checkpoint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of cumulative samples per checkpoint and source."""
    d = read_table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source")
    steps_ = [("small", {"passage_dump": 20, "step_logs": 5}), ("medium", {"passage_dump": 100, "step_logs": 30}), ("large", {"passage_dump": 1000000, "step_logs": 40})]
    return classify.checkpoint_sizes(d, "source", classify.hash_place(F.col("doc_id")), steps_)


_SIZES_SQL = """with n as (select source, count(*) as n from documents where source in ('passage_dump', 'step_logs') group by source),
t(checkpoint, source, k) as (values ('small', 'passage_dump', 20), ('small', 'step_logs', 5), ('medium', 'passage_dump', 120), ('medium', 'step_logs', 35), ('large', 'passage_dump', 1000120), ('large', 'step_logs', 75))
select checkpoint, source, least(n, k) as size from t join n using (source)"""


def all_good_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories whose steps are all good and have as many labels as scores."""
    v = views.votes(spark, sf_dir, "critic_step_labels", "critic_step_scores")
    good = F.forall("critic_step_labels", lambda x: x == 1) & (F.size("critic_step_labels") > 0) & (F.size("critic_step_labels") == F.size("critic_step_scores"))
    return v.where(good).select("trajectory_id", F.size("critic_step_labels").alias("n_steps"))


_GOOD_SQL = f"with {V} select trajectory_id, cast(len(critic_step_labels) as integer) as n_steps from votes where len(critic_step_labels) > 0 and list_min(critic_step_labels) = 1 and list_max(critic_step_labels) = 1 and len(list_filter(critic_step_labels, lambda x: x is null)) = 0 and len(critic_step_labels) = len(critic_step_scores)"


# ------------------------------------------------------------------ pairs


def _pairs(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs.attempt_pairs(_attempts(spark, sf_dir), strategy)

    return run


def _pairs_sql(worst: bool) -> str:
    return f"""with {V}, c as (select *, row_number() over (partition by question_id order by score desc, ord) as r from votes where is_correct), w as (select *, row_number() over (partition by question_id order by score, ord) as r from votes where not is_correct)
select c.question_id, c.trajectory_id as chosen, w.trajectory_id as rejected, round(c.score - w.score, 6) + 0.0 as margin from c join w on c.question_id = w.question_id where c.r = 1 {'and w.r = 1' if worst else ''}"""


def dpo_all_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean margin of all pairs of a right and a wrong attempt per question."""
    return pairs.margin_summary(_attempts(spark, sf_dir))


_MARGIN_SQL = f"""with {V} select question_id, nc * nr as n_pairs, round(sc / nc - sr / nr, 10) + 0.0 as mean_margin from (
select question_id, count(*) filter (where is_correct) as nc, count(*) filter (where not is_correct) as nr, sum(score) filter (where is_correct) as sc, sum(score) filter (where not is_correct) as sr from votes group by question_id) where nc > 0 and nr > 0"""


def union_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all sources together, regenerated ones told apart."""
    p = read_table(spark, sf_dir, "preference_pairs").select("pair_id", "source", "step_level")
    old, new = p.where("source <> 'regen_dpo'"), p.where("source = 'regen_dpo'")
    return old.withColumn("regenerated", F.lit(False)).unionByName(new.withColumn("regenerated", F.lit(True)))


_UNION_SQL = "select pair_id, source, step_level, source = 'regen_dpo' as regenerated from preference_pairs where source is not null"


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories that no critic has scored yet."""
    t = read_table(spark, sf_dir, "trajectories").select("trajectory_id").distinct()
    return pairs.unprocessed(t, read_table(spark, sf_dir, "scored_trajectories"), "trajectory_id")


_ANTI_SQL = "select distinct trajectory_id from trajectories t where not exists (select 1 from scored_trajectories s where s.trajectory_id = t.trajectory_id)"


def resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trajectory with its stored score, or 0.5 where it has none."""
    t = read_table(spark, sf_dir, "trajectories").select("trajectory_id").distinct()
    v = views.votes(spark, sf_dir).select("trajectory_id", "score")
    return pairs.resumed(t, v, "trajectory_id", "score", F.lit(0.5)).select("trajectory_id", F.round("score", 6).alias("score"))


_MERGE_SQL = f"with {V} select trajectory_id, round(coalesce(score, 0.5), 6) as score from (select distinct trajectory_id from trajectories) t left join votes using (trajectory_id)"


def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with their latest critic scores."""
    t = read_table(spark, sf_dir, "trajectories")
    t = classify.last_per_id(t.select("trajectory_id", "question", "n_steps", "created_at", "ingested_at"), "trajectory_id", ["created_at", "ingested_at"])
    v = views.votes(spark, sf_dir, "critic_step_scores", "critic_step_labels").select("trajectory_id", "critic_step_scores", "critic_step_labels", "score")
    m = classify.merge_scores(t, v)
    return m.select("trajectory_id", "question", F.round("score", 6).alias("score"), (F.size("critic_step_labels") == F.col("n_steps")).alias("aligned"))


_MERGED_SQL = f"""with {V}, t as (select trajectory_id, arg_max(question, ingested_at) as question, arg_max(n_steps, ingested_at) as n_steps from trajectories group by trajectory_id)
select trajectory_id, question, round(score, 6) as score, len(coalesce(critic_step_labels, critic_step_scores)) = n_steps as aligned from t join votes using (trajectory_id)"""

QUERIES = {f"vote_{m}" if m != "best_of_n" else m: _vote(m) for m in voting.METHODS} | {
    "vote_leaderboard": vote_leaderboard, "vote_details": vote_details, "vote_grid": vote_grid, "step_rows_stats": step_rows_stats, "step_rows": step_rows, "step_score_agg": step_score_agg, "consensus_steps": consensus_steps, "consensus_trajectories": consensus_trajectories,
    "consensus_stats": consensus_stats, "consensus_confidence": consensus_confidence, "agreement_kappa": agreement_kappa, "label_quality": label_quality, "training_samples": training_samples, "mc_rpe": mc_rpe,
    "take_until_bad": take_until_bad, "truncate_first_bad": truncate_first_bad, "classify_questions": classify_questions, "best_per_question": best_per_question, "difficulty_class": _difficulties, "difficulty_stats": difficulty_stats,
    "stratified_sample": stratified_sample, "checkpoint_sizes": checkpoint_sizes, "all_good_filter": all_good_filter, "dpo_best_vs_all": _pairs("best_vs_all"), "dpo_best_vs_worst": _pairs("best_vs_worst"), "dpo_all_margins": dpo_all_margins,
    "union_pairs": union_pairs, "resume_anti_join": resume_anti_join, "resume_merge": resume_merge, "merge_scores": merge_scores,
}
SQL = {f"vote_{m}" if m != "best_of_n" else m: _vote_sql(m) for m in voting.METHODS} | {
    "vote_leaderboard": _BOARD_SQL, "vote_details": _DETAILS_SQL, "vote_grid": _GRID_SQL, "step_rows_stats": _STEP_ROWS_SQL, "step_rows": _STEP_ROW_SQL, "step_score_agg": _AGG_SQL, "consensus_steps": _CONSENSUS_SQL, "consensus_trajectories": _TRAJ_SQL, "consensus_stats": _STATS_SQL,
    "consensus_confidence": _CONFIDENT_SQL, "agreement_kappa": _KAPPA_SQL, "label_quality": _QUALITY_SQL, "training_samples": _SAMPLES_SQL, "mc_rpe": _RPE_SQL, "take_until_bad": _UNTIL_SQL, "truncate_first_bad": _FIRST_BAD_SQL,
    "classify_questions": _CLASSIFY_SQL, "best_per_question": _BEST_SQL, "difficulty_class": f"with {_DIFF} select * from d", "difficulty_stats": f"with {_DIFF} select difficulty, count(*) as n, round(avg(n_steps), 6) as mean_steps, round(avg(avg_mc), 4) as mean_mc from d group by difficulty",
    "stratified_sample": _SAMPLE_SQL, "checkpoint_sizes": _SIZES_SQL, "all_good_filter": _GOOD_SQL, "dpo_best_vs_all": _pairs_sql(False), "dpo_best_vs_worst": _pairs_sql(True), "dpo_all_margins": _MARGIN_SQL,
    "union_pairs": _UNION_SQL, "resume_anti_join": _ANTI_SQL, "resume_merge": _MERGE_SQL, "merge_scores": _MERGED_SQL,
}
