import random

import numpy as np
import pytest

from steploom.llm import consensus
from steploom.llm.consensus import Consensus
from steploom.llm.q_consensus import verdict

SCHEMA = "t string, s int, who string, vote int, at long, who2 string, x int"


def make(seed, items=1500, informative=False):
    rng = random.Random(seed)
    right = {"good": (0.93, 0.9), "fair": (0.8, 0.85), "lenient": (0.97, 0.2), "guess": (0.5, 0.5), "mirror": (0.12, 0.1), "solid": (0.9, 0.94)}
    rows, truth, features = [], {}, []
    for k in range(items):
        f = rng.gauss(0, 1)
        y = int(rng.random() < (1 / (1 + np.exp(-3 * f)) if informative else 0.6))
        truth[f"t{k}", k % 4] = y
        features.append((f"t{k}", k % 4, [f]))
        for who in rng.sample(sorted(right), 1 if informative else 4):
            v = y if rng.random() < right[who][1 - y] else 1 - y
            rows.append((f"t{k}", k % 4, who, v, rng.randrange(5, 9), "z", 1))
    return rows, truth, features, right


def accuracy(found, truth):
    return np.mean([truth[r.t, r.s] == r.consensus for r in found])


def test_beats_majority_and_finds_reversed_annotators(spark):
    rows, truth, _, right = make(1)
    # revised and repeated labels: an earlier opposite vote, and the same row again
    rows += [(t, s, w, 1 - v, 1, z, x) for t, s, w, v, _, z, x in rows[::5]] + rows[::7]
    c = Consensus(spark.createDataFrame(rows, SCHEMA).repartition(4), ["t", "s"], "who", "vote", ["at"])
    found = c.labels().collect()
    votes = {}
    for t, s, _, v, at, *_ in {r[:5]: r for r in rows if r[4] > 1}.values():
        votes.setdefault((t, s), []).append(v)
    majority = np.mean([truth[k] == (np.mean(v) >= 0.5) for k, v in votes.items()])
    assert len(found) == len(truth)
    assert accuracy(found, truth) > max(majority + 0.03, 0.93)
    rel = {r.annotator: r for r in c.reliability().collect()}
    for who, (good, bad) in right.items():
        assert rel[who].right_1 == pytest.approx(good, abs=0.06) and rel[who].right_0 == pytest.approx(bad, abs=0.06)
    assert rel["mirror"].reliability < -0.6


def test_informative_features_help(spark):
    rows, truth, features, _ = make(2, informative=True)
    votes = spark.createDataFrame(rows, SCHEMA)
    x = spark.createDataFrame(features[:-3], "t string, s int, x array<double>")  # three items have none
    plain = accuracy(Consensus(votes, ["t", "s"], "who", "vote", ["at"]).labels().collect(), truth)
    assisted = accuracy(Consensus(votes, ["t", "s"], "who", "vote", ["at"], x, 1).labels().collect(), truth)
    assert assisted > plain + 0.03


def test_nulls_ties_and_empty(spark):
    rows = [("a", 0, "w", 1, 1, "", 0), ("a", 0, "w", None, 2, "", 0), (None, 0, "w", 1, 1, "", 0), ("b", None, "w", 1, 1, "", 0), ("c", 0, None, 1, 1, "", 0), ("d", 0, "w", 0, None, "", 0), ("d", 0, "w", 1, 1, "", 0)]
    found = Consensus(spark.createDataFrame(rows, SCHEMA), ["t", "s"], "who", "vote", ["at"]).labels().collect()
    assert [(r.t, r.s, r.consensus, r.n_votes) for r in found] == [("d", 0, 1, 1)]
    assert Consensus(spark.createDataFrame([], SCHEMA), ["t", "s"], "who", "vote", ["at"]).labels().collect() == []


def test_verdicts(spark):
    labels = ["GOOD", " good", "Good.", "1", "BAD\n", "bad", "0", "", "unknown", None, "borderline"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(labels)], "k int, v string")
    assert [r[0] for r in df.orderBy("k").select(verdict(df.v)).collect()] == [1, 1, 1, 1, 0, 0, 0, None, None, None, None]


def test_keys_may_be_called_like_inner_columns(spark):
    votes = spark.createDataFrame([("i", "w", 1, 1), ("i", "v", 1, 1), ("k", "w", 0, 1)], "who string, x string, vote int, votes int")
    found = Consensus(votes, ["who"], "x", "vote", ["votes"]).labels().collect()
    assert {(r.who, r.n_votes) for r in found} == {("i", 2), ("k", 1)}


@pytest.mark.parametrize("told", [True, False])
def test_confidence_counts_only_where_it_tells(spark, monkeypatch, told):
    monkeypatch.setattr(consensus, "ROUNDS", 15)
    rng = random.Random(6)
    rows, truth = [], {}
    for k in range(2000):
        y = truth[f"t{k}", 0] = int(rng.random() < 0.5)
        for who in "abc":
            sure = rng.random()
            right = rng.random() < (0.5 + 0.48 * sure if told else 0.74)
            rows.append((f"t{k}", 0, who, y if right else 1 - y, 1, None if rng.random() < 0.1 else 100 * sure))
    df = spark.createDataFrame(rows, "t string, s int, who string, vote int, at long, sure double")
    plain, calibrated = (Consensus(df, ["t", "s"], "who", "vote", ["at"], confidence=c) for c in (None, "sure"))
    gain = accuracy(calibrated.labels().collect(), truth) - accuracy(plain.labels().collect(), truth)
    spread = [r.calibration for r in calibrated.reliability().collect()]
    assert (gain > 0 and min(spread) > 0.2) if told else (abs(gain) < 0.01 and max(map(abs, spread)) < 0.2)
