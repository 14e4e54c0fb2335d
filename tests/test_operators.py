import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steploom.operators import classify, losses, models, pairs, retrieval, scaling, tree
from steploom.sources import config, files, schemas
from steploom.streaming import pipelines


def test_all_vs_all_pairs_match_their_summary(spark):
    rng = random.Random(1)
    rows = [(f"q{rng.randrange(5)}", k, f"t{k}", rng.random() < 0.5, rng.random()) for k in range(60)]
    df = spark.createDataFrame(rows, "question_id string, ord int, trajectory_id string, is_correct boolean, critic_min double")
    every = pairs.attempt_pairs(df, "all_vs_all").groupBy("question_id").agg(F.count("*").alias("n"), F.avg("margin").alias("m")).collect()
    summary = {r.question_id: r for r in pairs.margin_summary(df).collect()}
    assert {r.question_id: r.n for r in every} == {k: r.n_pairs for k, r in summary.items()}
    assert all(summary[r.question_id].mean_margin == pytest.approx(r.m, abs=1e-5) for r in every)


def test_bm25_against_plain_python(spark):
    docs = [(1, "the cat sat"), (2, "the dog sat on the cat"), (3, "a bird"), (4, None), (5, "")]
    index = retrieval.Bm25Index.build(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    hits = index.search(spark.createDataFrame([(7, "cat cat bird")], "q long, t string"), "q", "t", 5).collect()
    toks = {d: (t or "").split() for d, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    score = {d: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ["cat", "cat", "bird"] if w in t) for d, t in toks.items()}
    want = sorted((round(-s, 6), d) for d, s in score.items() if any(w in toks[d] for w in ("cat", "bird")))
    assert [(h.doc_id, h.score) for h in hits] == [(d, -s) for s, d in want]


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    hits = retrieval.dense_top_k(df, df.where("id % 10 = 0"), "id", "id", "v", 4, 8, parts=3).collect()
    m = np.array([v for _, v in rows[:300]])
    for q in range(0, 300, 10):
        want = sorted(range(300), key=lambda d: (-round(float(m[q] @ m[d]), 6), d))[:4]
        assert [h.doc_id for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == q] == want


def test_cell_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    queries = df.where("id % 20 = 0")
    exact = {(r.query_id, r.doc_id) for r in retrieval.dense_top_k(df, queries, "id", "id", "v", 10, 16).collect()}
    found = {(r.query_id, r.doc_id) for r in retrieval.IvfIndex(df, "id", "v", 16).search(queries, "id", 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_fusion_and_normalisation(spark):
    a = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 3.0, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.9, 2)], a.schema)
    got = {r.doc_id: r.score for r in retrieval.reciprocal_fusion(a, b, 5).collect()}
    assert got == {11: 0.032522, 10: 0.016393, 12: 0.016129}
    assert {r.doc_id: r.norm for r in retrieval.min_max(b).collect()} == {11: 1.0, 12: 1.0}
    assert [r.doc_id for r in retrieval.weighted_fusion(a, b, 2, 0.5).orderBy("rank").collect()] == [10, 11]


def test_tree_operators_against_recursion(spark):
    rng = random.Random(3)
    nodes = []
    for q in range(20):
        for i in range(rng.randrange(1, 25)):
            nodes.append((q, i, (i - 1) // 2 if i else None, int(math.log2(i + 1)), rng.randrange(0, 4), rng.random()))
    last = {q: max(n[1] for n in nodes if n[0] == q) for q in range(20)}
    rows = [(q, i, p, d, v, 2 * i + 1 > last[q], f) for q, i, p, d, v, f in nodes]
    df = spark.createDataFrame(rows, "question_id int, id int, parent_id int, depth int, visit_count int, is_terminal boolean, f1 double")
    got = {(r.question_id, r.id): r.reward for r in tree.propagate_rewards(df, max_depth=5).collect()}

    def reward(q, i):
        me = next(r for r in rows if r[:2] == (q, i))
        if me[5]:
            return me[6] * 0.9 ** me[3]
        kids = [(reward(q, r[1]), r[4]) for r in rows if r[0] == q and r[2] == i]
        total = sum(n for _, n in kids)
        return sum(x * n for x, n in kids) / total if total else sum(x for x, _ in kids) / len(kids)

    assert all(got[r[:2]] == pytest.approx(reward(*r[:2]), abs=1e-8) for r in rows)
    up = {(r.question_id, r.id): r.visits for r in tree.backpropagate(df, df.select("question_id", "id", F.lit(1.0).alias("value")), 5).collect()}
    assert all(up[q, 0] == last[q] + 1 for q in range(20))


def test_ucb_prefers_unvisited(spark):
    assert spark.range(1).select(tree.ucb(F.lit(0.0), F.lit(0), F.lit(9)).alias("u")).first().u == float("inf")


def test_losses(spark):
    row = spark.range(1).select(losses.kto_loss(F.lit(50.0), F.lit(0.0), F.lit(True)).alias("k"), losses.dpo_loss(F.lit(-800.0), F.lit(800.0), 1.0).alias("d"), losses.log_softmax_at(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)).alias("s")).first()
    assert row.k == pytest.approx(1 - 1 / (1 + math.exp(-1.0))) and row.d == pytest.approx(1600) and row.s == pytest.approx(-math.log(2))


def test_scaling_fit(spark):
    pts = [("p", n, 3.0 * n**0.5) for n in (1, 4, 9)] + [("l", 1, -1.0), ("l", 2, 1.0), ("l", 3, 3.0), ("one", 5, 2.0), ("flat", 5, 1.0), ("flat", 5, 2.0), ("null", None, 1.0)]
    got = {r.k: r for r in scaling.fit_power_law(spark.createDataFrame(pts, "k string, n int, m double"), "k", "n", "m").collect()}
    assert (got["p"].a, got["p"].b, got["p"].c, got["p"].r2) == pytest.approx((3, 0.5, 0, 1))
    assert (got["l"].a, got["l"].b, got["l"].c) == pytest.approx((2, 1, -3))
    assert (got["one"].a, got["one"].r2) == (0, 0) and (got["flat"].a, got["flat"].b, got["flat"].r2) == (1, 0, 0)


def test_nested_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id long, s string")
    small = {r.id for r in classify.stratified_sample(df, "s", classify.hash_place(F.col("id")), {"a": 5}).collect()}
    large = {r.id for r in classify.stratified_sample(df, "s", classify.hash_place(F.col("id")), {"a": 20, "b": 1000}).collect()}
    assert len(small) == 5 and small < large and len(large) == 70


def test_generation_loop_and_regeneration(spark):
    q = spark.createDataFrame([(f"q{i}", f"what is {i}?") for i in range(12)], "question_id string, question string")
    script = lambda: models.ReplayModel(["<think>a</think><search>x</search>", "<think>b</think><answer>42</answer>"])
    find = lambda df: df.withColumn("observation", F.when(F.col("input").isNotNull(), F.lit("<documents>d</documents>")))
    a = models.generation_loop(q, script, find, max_steps=6).orderBy("question_id").collect()
    b = models.generation_loop(q.repartition(5), script, find, max_steps=6).orderBy("question_id").collect()
    assert a == b and len(a) == 12 and all(len(r.steps) <= 6 for r in a) and all(r.final_answer == "42" for r in a if r.finished)
    cut = spark.createDataFrame([("t1", "q", ["s1", "s2"])], "trajectory_id string, question string, good_steps array<string>")
    assert models.regenerated(cut, script, max_steps=4).first().trajectory_id == "t1_regen"


def test_failing_model_gives_default_rows(spark):
    class Broken:
        def generate(self, prompts):
            raise RuntimeError("down")

    df = spark.createDataFrame([("p",)], "prompt string")
    assert models.generated(df, "prompt", Broken, default="[]").first().response == "[]"


def test_rollout_labels(spark):
    steps = spark.createDataFrame([(1, "x", "x y", "42"), (2, "x", "x", None)], "id int, prefix_before string, prefix_after string, gold string")
    got = models.RolloutLabeler(lambda: models.ReplayModel(["42", "no"]), lambda r, g: r == g).transform(steps).collect()
    assert {r.id for r in got} == {1, 2} and next(r for r in got if r.id == 2).mc_after == 0


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id":"a","question":"Q1","answer":"x"}\n{"question":"Q2","gold_answer":"y"}\n')
    (tmp_path / "q.json").write_text('{"data":[{"id":"a","question":"Q1","answer":"x"}]}')
    (tmp_path / "list.json").write_text('[{"id":"a","question":"Q1"},{"id":"b","question":"Q2"}]')
    rows = files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert rows[0].question_id == "a" and rows[1].question_id.startswith("h") and rows[1].gold_answer == "y"
    assert files.read_questions(spark, str(tmp_path / "q.json")).first().gold_answer == "x"
    assert files.read_questions(spark, str(tmp_path / "list.json"), limit=1).count() == 1
    (tmp_path / "c.jsonl").write_text('{"id":"1","title":"T","text":"' + "z" * 1300 + '"}\n{"contents":"T2\\nbody"}\nnot json\n')
    corpus = files.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()
    assert corpus[0].text.endswith("[TRUNCATED]") and (corpus[1].title, corpus[1].text) == ("T2", "body")
    files.write_rows(spark.createDataFrame([("t", None)], "trajectory_id string, x string"), str(tmp_path / "o"), "jsonl")
    assert files.processed_ids(spark, str(tmp_path / "o")).first().trajectory_id == "t"
    with pytest.raises(ValueError):
        files.write_rows(spark.range(1), str(tmp_path / "p"), "xml")
    (tmp_path / "t.jsonl").write_text('{"question":"Q"}\n')
    with pytest.raises(Exception, match="trajectory_id is missing"):
        files.read_trajectories(spark, str(tmp_path / "t.jsonl")).collect()


def test_ordinal_and_contexts(spark):
    df = spark.range(100).repartition(7)
    assert sorted((r.id, r.ord) for r in files.with_ordinal(df, "id").collect()) == [(i, i) for i in range(100)]
    q = spark.createDataFrame([("q1", [("T", ["a", "b"])]), ("q2", [("T", ["a", "b"]), ("U", ["c"])])], "question_id string, context array<struct<title:string,sentences:array<string>>>")
    assert [(r.doc_id, r.title, r.text) for r in files.corpus_from_contexts(q).orderBy("doc_id").collect()] == [("doc_0", "T", "a b"), ("doc_1", "U", "c")]


def test_schema_checks(spark):
    df = spark.createDataFrame([("GOOD",), (None,)], "label string")
    assert schemas.checked(df, "label", schemas.LABELS).count() == 2
    with pytest.raises(Exception, match="unknown label"):
        schemas.checked(spark.createDataFrame([("x",)], "label string"), "label", schemas.LABELS).collect()


def test_config(tmp_path):
    c = config.from_dict(config.merged({"retrieval": {"top_k": 5, "alpha": 0.1}}, {"retrieval": {"top_k": 9, "nonsense": 1}, "seed": 3}))
    assert (c.retrieval.top_k, c.retrieval.alpha, c.seed, c.search.max_depth) == (9, 0.1, 3, 7)
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c


def test_sessions_and_resume(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:05:00"), (1, "2025-01-01 02:00:00"), (2, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in/a"))
    stream = pipelines.file_stream(spark, str(tmp_path / "in/*"), df.schema)
    got = pipelines.run_to_end(pipelines.sessions(stream, "t", "k", "10 minutes", "1 minute"), "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    seen = []
    pipelines.each_batch(pipelines.file_stream(spark, str(tmp_path / "in/*"), df.schema), lambda b, i: seen.append(b.count()), str(tmp_path / "log"))
    df.limit(1).write.parquet(str(tmp_path / "in/b"))
    pipelines.each_batch(pipelines.file_stream(spark, str(tmp_path / "in/*"), df.schema), lambda b, i: seen.append(b.count()), str(tmp_path / "log"))
    assert sum(seen[:-1]) == 4 and seen[-1] == 1
