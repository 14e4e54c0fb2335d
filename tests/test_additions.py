"""Evaluation, training rows, scans that are written first, frontiers, callbacks and length stops."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from steploom.operators import classify, evaluation, experiments, models, pairs, retrieval, search_loop, training_rows, voting
from steploom.sources import files


def test_evaluate_counts_missing_predictions_as_wrong(spark):
    rows = spark.createDataFrame([("a", "the Orlo", "Orlo"), ("a", None, "x"), ("b", "y", None), ("a", "no", "yes")], "split string, p string, g string")
    got = evaluation.evaluate(rows, "p", "g", ["split"]).collect()
    assert [tuple(r) for r in got] == [("a", 3, 2, pytest.approx(33.333333), pytest.approx(33.333333))]
    with pytest.raises(ValueError, match="unknown"):
        evaluation.evaluate(rows, "p", "g", [], ("bleu",))


def test_scoring_grid(spark):
    rows = [("q", 1, "a", [0.9, 0.1]), ("q", 2, "b", [0.4, 0.4]), ("q", 3, "", [1.0]), ("q", 4, "b", None)]
    votes = spark.createDataFrame(rows, "question_id string, ord int, answer string, s array<double>")
    got = {(r.scoring, r.method): r.correct for r in voting.scoring_grid(votes, spark.createDataFrame([("q", "a")], "question_id string, gold string"), "s").collect()}
    assert len(got) == 9 and got["min", "weighted"] == 0 and got["avg", "weighted"] == 1 and got["avg", "majority"] == 0 and got["avg", "best_of_n"] == 0


def test_step_rows_and_counters(spark):
    rows = [("t", 0, "Q", "go <documents>a b</documents> on", 1), ("t", 1, "Q", None, None), ("t", 2, "Q", "end", 0), ("u", 0, None, "x", None)]
    steps = spark.createDataFrame(rows, "trajectory_id string, step_id int, question string, text string, label int")
    made = training_rows.step_rows(steps)
    got = {r.step_id: r for r in made.collect()}
    assert set(got) == {0, 2} and got[0].prompt == "Q" and got[2].prompt == "Q\ngo <documents>a b</documents> on\n" and not got[2].good and got[0].n_masked == 2
    assert tuple(training_rows.step_counters(steps, made).first()) == (4, 2, 2, 1, 1, 5, 2)
    assert training_rows.step_rows(steps.where("false")).count() == 0


def test_pair_rows_leave_out_missing_and_equal_texts(spark):
    p = spark.createDataFrame([("q", "a", "b", 0.5), ("q", "a", "c", 0.1), ("q", "a", "z", 0.1)], "question_id string, chosen string, rejected string, margin double")
    texts = spark.createDataFrame([("a", "P", "x"), ("b", "P", "y"), ("c", "P", "x")], "trajectory_id string, prompt string, text string")
    rows = training_rows.pair_rows(p, texts)
    assert [tuple(r) for r in rows.collect()] == [("q", "P", "x", "y", 0.5)]
    assert tuple(training_rows.pair_counters(p, rows).first()) == (3, 1, 2, 0.5)
    flips = spark.createDataFrame([(0.2, 0.5), (0.5, 0.2)], "chosen_f1 double, rejected_f1 double")
    assert tuple(pairs.critic_flipped(flips).first()) == (2, 1)


def test_annotations_go_through_json(spark):
    df = spark.createDataFrame([((1, "GOOD"),), (None,)], "a struct<step_id:int,label:string>")
    back = df.select(training_rows.annotations_of(training_rows.annotations_json(F.col("a")), "step_id int, label string").alias("a"))
    assert [r.a and tuple(r.a) for r in back.collect()] == [(1, "GOOD"), None]


def test_trees_and_vectors_are_read_as_written(spark, tmp_path):
    nodes = spark.createDataFrame([("q", 0, None, 0, False), ("q", 1, 0, 1, True), ("q", 4, 0, 1, False)], "question_id string, id int, parent_id int, depth int, is_terminal boolean")
    files.write_trees(nodes, f"{tmp_path}/t")
    got, trees = files.read_trees(spark, f"{tmp_path}/t", 3, 2)
    assert [tuple(r) for r in trees.collect()] == [("q", 0, 5, 3, 2)] and {r.visit_count for r in got.collect()} == {0}
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "vec_id long, v array<double>")
    files.write_vectors(v, f"{tmp_path}/v", "vec_id", "v")
    assert files.read_vectors(spark, f"{tmp_path}/v", 3).count() == 3
    with pytest.raises(ValueError, match="vectors"):
        files.read_vectors(spark, f"{tmp_path}/v", 9)
    with pytest.raises(ValueError, match="numbers"):
        files.write_vectors(v.union(spark.createDataFrame([(9, [1.0])], v.schema)), f"{tmp_path}/w", "vec_id", "v")


def test_question_files_in_all_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "question": "x?", "answer": "y"},\n {"_id": "2", "question": "z?"}]')
    (tmp_path / "b.json").write_text('{"data": [{"id": "3", "question": "u?", "gold_answer": "v"}]}')
    (tmp_path / "c.json").write_text('{"id": "4", "question": "w?"}')
    got = [sorted(tuple(r) for r in files.read_questions(spark, f"{tmp_path}/{n}.json").collect()) for n in "abc"]
    assert got == [[("1", "x?", "y"), ("2", "z?", None)], [("3", "u?", "v")], [("4", "w?", None)]]


def test_documents_without_an_id_are_counted(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(f'{{"contents": "T{k}\\nbody {k}"}}\n' for k in range(5)))
    assert [(r.doc_id, r.text) for r in files.read_corpus(spark, f"{tmp_path}/c.jsonl").orderBy("doc_id").collect()] == [(f"doc_{k}", f"body {k}") for k in range(5)]


def test_steps_to_judge_count_from_zero(spark):
    step = "struct<step_id:int,step_type:string,think:string,search:string,answer:string,documents:string>"
    t = spark.createDataFrame([("t", "q?", "g", [(1, "rag", "hm", "x", None, "d"), (2, "answer", None, None, "y", None)])], f"trajectory_id string, question string, gold_answer string, steps array<{step}>")
    got = files.steps_to_judge(t).orderBy("step_id").collect()
    assert [(r.step_id, r.step_type) for r in got] == [(0, "rag"), (1, "finish")] and got[1].previous == [got[0].text] and "<answer>y</answer>" in got[1].text


def test_saved_indexes_find_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue whale"), (3, None), (4, "red red whale")], "d long, t string")
    asked = spark.createDataFrame([(7, "red whale"), (8, None), (9, "unheard")], "q long, t string")
    index = retrieval.Bm25Index.build(docs, "d", "t")
    index.save(f"{tmp_path}/b")
    a, b = (i.search(asked, "q", "t", 2).collect() for i in (index, retrieval.Bm25Index.open(spark, f"{tmp_path}/b")))
    assert sorted(a) == sorted(b) and {r.query_id for r in a} == {7}
    v = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(60)], "d long, v array<double>")
    ivf = retrieval.IvfIndex(v, "d", "v", 3)
    ivf.save(f"{tmp_path}/i")
    a, b = (i.search(v.where("d < 3"), "d", 4).collect() for i in (ivf, retrieval.IvfIndex.open(spark, f"{tmp_path}/i", "v")))
    assert sorted(a) == sorted(b) and len(a) == 12
    assert [r[0] for r in docs.select(retrieval.prefixed(F.col("t"), True)).collect()][1:3] == ["query: blue whale", None]


def test_prompts_near_the_limit_finish_without_an_answer(spark):
    q = spark.createDataFrame([("a", "short?"), ("b", "long " * 40)], "question_id string, question string")
    got = {r.question_id: r for r in models.generation_loop(q, lambda: models.ReplayModel(["Action: finish[x]"]), max_steps=2, max_length=30).collect()}
    assert got["b"].finished and got["b"].final_answer is None and got["b"].steps == [] and len(got["a"].steps) > 0


def test_step_scores(spark):
    df = spark.createDataFrame([(["a b", "a c", "x"],), (None,)], "s array<string>")
    got = [r.step_scores for r in models.step_scored(df, "s", models.OverlapStepScorer).collect()]
    assert got == [[1.0, pytest.approx(1 / 3), 0.0], []]


def test_callbacks_and_run_names():
    class Ends(experiments.MetricLog):
        ended = 0

        def on_train_end(self, checkpoints):
            self.ended += len(checkpoints)

    log = Ends()
    e = experiments.Experiment("e", [experiments.Checkpoint("c", 1)], callbacks=(log,))
    e.train, e.evaluate = lambda c: 0.5, lambda c: {"em": 1.0}
    e.run()
    assert log.rows == [("c", "loss", 0.5), ("c", "em", 1.0)] and log.ended == 1
    assert experiments.run_name("kto", datetime(2024, 3, 5, 6, 7, 8)) == "kto_20240305_060708"


def test_sample_is_bounded_before_the_sort(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).cast("string").alias("s"))
    sample = classify.stratified_sample(rows, "s", classify.hash_place(F.col("id")), {"0": 3, "1": 5})
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["count"] for r in sample.groupBy("s").count().collect()) == [3, 5]


def test_regeneration_goes_on_from_searches(spark):
    questions = spark.createDataFrame([("q", "who?", "x")], "question_id string, question string, gold string")
    state = search_loop.roots(questions)
    targets = spark.createDataFrame([("q", 0, "wrong")], "question_id string, bad_id int, feedback string")
    searching = lambda: models.ReplayModel(["a</think><search>b</search>"])
    grown = search_loop.regenerate_frontier(state, targets, searching, lambda d: d.withColumn("score", F.lit(1)), rounds=3, samples=2).collect()
    assert len({r.id for r in grown}) == len(grown) == 1 + 2 + 4 + 8 and max(r.depth for r in grown) == 3
    assert all(r.critic == 1 for r in grown if r.depth) and next(r for r in grown if r.id == 0).visit_count == 14
    ending = lambda: models.ReplayModel(["a</think><answer>x</answer>"])
    assert search_loop.regenerate_frontier(state, targets, ending, rounds=3, samples=2).count() == 3


def test_stored_tables_are_cleared(spark):
    from steploom.plans import storage

    storage.clear_stored(spark)
    df = storage.store(spark.range(3).toDF("id"), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and storage.is_stored(spark, path)
    assert storage.clear_stored(spark) == 1 and not storage.is_stored(spark, path)
