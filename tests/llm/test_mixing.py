import random

import pytest

from steploom.llm.mixing import Mix, entropy, exponent_for_entropy, exponent_for_limits, feasible_budget, plan_mix, tempered


def test_tempered_path():
    p, q = [0.7, 0.2, 0.1], [0.2, 0.3, 0.5]
    assert tempered(p, 1.0, q) == pytest.approx(p)
    assert tempered(p, 0.0, q) == pytest.approx(q)
    assert tempered(p, 0.0) == pytest.approx([1 / 3] * 3)
    assert tempered([0.0, 1.0], 0.5, [0.5, 0.5]) == [0.0, 1.0]


def test_entropy_is_met():
    p = [0.8, 0.15, 0.05]
    t = exponent_for_entropy(p, 0.9)
    assert entropy(tempered(p, t)) == pytest.approx(0.9, abs=1e-9)
    assert exponent_for_entropy(p, 9.0) == 0.0


def test_limits_are_met_with_the_smallest_exponent():
    tokens, q, k = [900.0, 100.0], [0.5, 0.5], [2.0, 2.0]
    t = exponent_for_limits(tokens, q, k, 1000.0)
    w = tempered([0.9, 0.1], t, q)
    assert w[1] * 1000 == pytest.approx(200, rel=1e-6)
    assert plan_mix(tokens, q, k)[2] == pytest.approx(feasible_budget(tokens, q, k)) == 400


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(k, rng.choices(["big", "mid", "small", None, "other"], [60, 20, 5, 3, 12])[0], rng.choice([0, 1, 5, 40, 90])) for k in range(6000)]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "record long, source string, n_tokens long, block int, full string, cut int").repartition(5)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 2), ("small", 0.15, 4), ("missing", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_passes int")
    mix = Mix(df, targets)
    out = {r.source: r for r in mix.shares().collect()}
    assert out["missing"].actual_share == 0
    for s, q in (("big", 0.4), ("mid", 0.35), ("small", 0.15)):
        assert out[s].actual_share == pytest.approx(q / 0.9, abs=2e-3)
        assert out[s].most_passes <= out[s].max_passes
    passes = mix.passes().collect()
    assert len(passes) == len(rows)
    assert all(r.passes == 0 for r in passes if r.source not in ("big", "mid", "small") or r.n_tokens == 0)
    by = [r.passes for r in passes if r.source == "small" and r.n_tokens]
    assert max(by) - min(by) <= 1  # whole passes before a further one


def test_empty_and_repeated(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_passes int")
    empty = spark.createDataFrame([], "record long, source string, n_tokens long")
    assert Mix(empty, targets).passes().count() == 0
    assert Mix(empty, targets).shares().first().actual_share == 0
    twice = spark.createDataFrame([(1, "a", 10), (1, "a", 10)], empty.schema)
    assert [r.passes for r in Mix(twice, targets).passes().collect()] == [2, 2]
