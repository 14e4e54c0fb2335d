import pytest
from pyspark.sql import functions as F

from steploom.functions import formatting
from steploom.operators import experiments, search_loop
from steploom.operators.models import ReplayModel, create
from steploom.sources import files, remote


# a lambda, so that workers get it by value and needn't import this module
model = lambda: ReplayModel(["a</think><search>x</search>", "b</think><answer>Orlo</answer>", "c</think><answer>Minko</answer>", "d</think><search>y</search>"])


def questions(spark):
    return spark.createDataFrame([(f"q{i}", f"what is {i}?", "Orlo") for i in range(6)], "question_id string, question string, gold string")


def test_descent(spark):
    rows = [(0, None, 0, 5, 1.0), (1, 0, 1, 3, 2.9), (2, 0, 1, 2, 0.1), (3, 1, 2, 0, 0.0)]
    nodes = spark.createDataFrame([("q", "w", "g", i, p, d, "", False, v, t, None, None, True) for i, p, d, v, t in rows], search_loop.STATE)
    assert [r.id for r in search_loop.descend(nodes, 2).collect()] == [1]  # full root, node 1 has room
    assert [r.id for r in search_loop.descend(nodes, 1).collect()] == [3]


def test_trees_grow_alike_and_add_up(spark):
    critic = lambda df: df.withColumn("score", F.pmod(F.xxhash64("text"), F.lit(2)))
    run = lambda q: search_loop.grow(q, model, critic, rollouts=5, max_depth=3, critic_every=2)
    state = run(questions(spark)).orderBy("question_id", "id").collect()
    again = run(questions(spark).repartition(3)).orderBy("question_id", "id").collect()
    assert [(r.question_id, r.id, r.text, r.visit_count, round(r.total_value, 9)) for r in state] == [(r.question_id, r.id, r.text, r.visit_count, round(r.total_value, 9)) for r in again]
    for r in state:
        kids = [k for k in state if (k.question_id, k.parent_id) == (r.question_id, r.id)]
        assert len(kids) <= 2 and (not r.is_terminal or not kids)
        if r.id == 0:
            assert r.visit_count == 5 == sum(k.visit_count for k in kids)
    assert any(r.critic is not None for r in state) and any(r.f1 == 1.0 for r in state)


def test_regeneration_adds_samples(spark):
    state = search_loop.grow(questions(spark), model, rollouts=2, max_depth=3)
    targets = state.where("depth = 1").groupBy("question_id").agg(F.min("id").alias("bad_id")).withColumn("feedback", F.lit("wrong"))
    grown = search_loop.regenerate(state, targets, model, samples=3)
    assert grown.count() == state.count() + 3 * 6
    assert grown.groupBy("question_id", "id").count().where("count > 1").count() == 0


def test_checkpoints(spark, tmp_path):
    state = search_loop.roots(questions(spark))
    for n in (5, 10):
        files.write_checkpoint(state.limit(n), str(tmp_path), n)
    last, nodes = files.read_checkpoint(spark, str(tmp_path))
    assert last == 10 and nodes.count() == 6


def test_experiment_runs_resumes_and_reports(spark):
    seen = []
    e = experiments.Experiment("e", [experiments.Checkpoint(n, 10 * k) for k, n in enumerate("abc", 1)], lambda c: seen.append([x.status for x in c]))
    e.train, e.evaluate = lambda c: c.num_samples / 10, lambda c: {"em": 1.0}
    e.run(start_from="b")
    assert [c.status for c in e.checkpoints] == ["pending", "evaluated", "evaluated"] and e.checkpoints[1].resume_from == "a"
    assert len(seen) == 6 and e.table(spark).where("status = 'evaluated'").count() == 2 and "loss 2.0000" in e.summary()
    e.run()
    assert e.checkpoints[0].status == "evaluated"


def test_predicates_shards_and_summary(spark):
    df = spark.createDataFrame([(0, 3), (2, 2), (4, 0)], "right int, wrong int")
    got = df.select(experiments.keep_sampling(F.lit(5), df.right, df.wrong).alias("k"), experiments.useful_question(df.right, df.wrong).alias("u")).collect()
    assert [(r.k, r.u) for r in got] == [(True, False), (False, True), (True, False)]
    rows = spark.range(100)
    parts = [experiments.shard(rows, "id", r, 3) for r in range(3)]
    assert sum(p.count() for p in parts) == 100
    assert experiments.shuffled(rows, "id", 1).collect() == experiments.shuffled(rows.repartition(5), "id", 1).collect()
    m = spark.createDataFrame([(10, 4), (10, 1)], "n int, m int")
    assert experiments.masking_summary(m, "n", "m").first().masked_pct == 25.0
    with pytest.raises(Exception, match="more masked"):
        experiments.masking_summary(spark.createDataFrame([(1, 4)], "n int, m int"), "n", "m").collect()


def test_retrievers(spark):
    def make():
        def fetch(query, k):
            if "fail" in query:
                raise OSError("no answer")
            return [(f"T{i}", "One is. Two is. Three is. Four.", f"u{i}") for i in range(9)]

        return fetch

    q = spark.createDataFrame([(1, "x"), (2, "fail")], "query_id int, query string")
    hits = remote.create_retriever("service", make, sentences=2).retrieve(q, 3).collect()
    assert [(h.query_id, h["rank"], h.text, round(h.score, 6)) for h in hits] == [(1, 1, "One is. Two is", 1.0), (1, 2, "One is. Two is", 0.9), (1, 3, "One is. Two is", 0.8)]
    corpus = spark.createDataFrame([(1, "a cat"), (2, "a dog"), (3, "birds")], "doc_id long, text string")
    assert remote.create_retriever("bm25", corpus).retrieve(spark.createDataFrame([(7, "dog")], "query_id int, query string"), 1).first().doc_id == 2
    with pytest.raises(ValueError):
        remote.create_retriever("none")
    with pytest.raises(ValueError):
        create("none")


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    steps = F.array(F.lit("s1"), F.lit("s2"))
    assert "## Step 2\ns2" in one(formatting.judge_prompt(F.lit("q"), F.lit(None).cast("string"), steps))
    assert one(formatting.feedback_prompt(F.lit("q"), steps, F.lit("f" * 900))).count("f") == 500
    assert one(formatting.response_template(F.lit("<|im_end|>\n<|im_start|>assistant\nhello"))).endswith("<|im_start|>assistant")
    assert one(formatting.percent_report({"good": F.lit(1)}, F.lit(4))) == "good: 1 (25.0%)"
    assert "- q1" in one(formatting.correction_prompt(F.lit("q"), steps, F.lit(1), F.lit("r"), F.array(F.lit("q1"), F.lit(""))))
