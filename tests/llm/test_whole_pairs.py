"""Pairs of very large groups, as the registered queries give them."""

from itertools import combinations

from steploom.llm import overlap, q_overlap, q_spans, q_splitting, spans


def test_p6_found_has_every_pair_of_a_large_component(spark, tmp_path):
    ids = [f"q{k:03}" for k in range(80)]
    rows = [(f"{b}_sample_{k}", a, True) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
    rows = spark.createDataFrame(rows, "trajectory_id string, question_id string, is_correct boolean")
    rows.write.parquet(f"{tmp_path}/scored_trajectories.parquet")
    rows.drop("question_id").write.parquet(f"{tmp_path}/trajectories.parquet")
    spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, proportion double").write.parquet(f"{tmp_path}/split_targets.parquet")
    assert {tuple(r) for r in q_splitting.p6_found(spark, str(tmp_path)).collect()} == set(combinations(ids, 2))


def test_p9_found_has_every_pair_of_a_crowd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spans, "PAIRWISE", 2)
    monkeypatch.setattr(spans, "CROWD", 5)
    header = "the same licence header of more than a hundred characters stands in front of each of these many files. "
    rows = [(k, header + f"body {k} " * 5) for k in range(9)] + [(50, "x" + header[:101]), (51, "nothing in common with the others")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in q_spans.p9_found(spark, str(tmp_path)).collect()} == set(combinations([*range(9), 50], 2))


def test_p3_found_has_every_pair_of_large_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK", 16)
    rows = [(f"t{k}", "train", "s", "Where did Tarpolin go?", "Orlo") for k in range(90)] + [(f"v{k}", "test", "s", "Where did Tarpolin go", "orlo") for k in range(70)]
    rows += [(f"u{k}", "validation", "s", "Where did Tarpoiln go?", "Orlo") for k in range(60)] + rows[:5]
    spark.createDataFrame(rows, "trajectory_id string, split string, source string, question string, gold_answer string").write.parquet(f"{tmp_path}/trajectories.parquet")
    got = [tuple(r) for r in q_overlap.p3_found(spark, str(tmp_path)).collect()]
    want = {(f"t{k}", f"{side}{j}") for k in range(90) for side, n in (("v", 70), ("u", 60)) for j in range(n)}
    assert len(got) == len(want) and set(got) == want
