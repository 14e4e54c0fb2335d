import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steploom.llm.truncation import Truncation, before_cut, combine, find_limits, fit_censored, odds_of


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = np.round(np.exp(rng.normal(5, 0.5, 40000)))
    lengths, counts = np.unique(np.minimum(x, 200), return_counts=True)
    mu, sigma = fit_censored(lengths, counts, np.array([200.0]))
    assert mu == pytest.approx(5, abs=0.02) and sigma == pytest.approx(0.5, abs=0.02)
    plain = fit_censored(lengths, counts, np.array([]))
    assert plain[0] < mu - 0.05  # taking cut values at face value is biased


def test_limits_need_unfinished_endings():
    rng = np.random.default_rng(2)
    x = np.round(np.exp(rng.normal(5, 0.5, 20000)))
    cut = x > 200
    lengths, place = np.unique(np.minimum(x, 200), return_inverse=True)
    counts, unfinished = np.bincount(place).astype(float), np.bincount(place, cut).astype(float)
    found = find_limits(lengths, lengths, counts, unfinished)
    assert {f[:2] for f in found} in ({("bytes", 200)}, {("chars", 200)}) and dict((f[2], f[3]) for f in found)[200] > 0.9
    assert find_limits(lengths, lengths, counts, 0 * unfinished) == []


def test_length_and_ending_outweigh_each_other():
    plain = odds_of({"closed": 3000.0, "open5": 100.0})
    assert combine(None, plain["quote"]) > 0.9 and combine(None, plain["closed"]) < 0.01
    assert combine(None, plain["open17"]) < 0.5 < combine(0.99, plain["open17"])  # what the ending leaves open, the length decides
    assert combine(0.001, plain["quote"]) < 0.5  # a length that complete texts have
    quoting = odds_of({"closed": 100.0, "quote.": 900.0})
    assert combine(None, quoting["quote"]) < 0.5 < combine(0.99, quoting["quote"])  # where odd quotes are usual they are no sign


def test_markers_are_not_part_of_the_length(spark):
    rows = [("the word [truncated]",), ("the word...",), ("the wor�",), ("the word.",), ("the [word]",)]
    df = spark.createDataFrame(rows, "t string").select(before_cut(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == ["the word", "the word", "the wor", "the word.", "the [word]"]


SENTENCES = ["The query for {0} returns {1} hits on chess instead of {2}.", "It contradicts step {1}, where {0} had been ruled out for {2}.", "Uses the late record of {0} well: it links {2} to the answer.", "Fire took the roof of {0} in {1}; {2} paid for a new one!"]


def sentence(rng):
    name = lambda: rng.choice(["Ann", "Bea", "Cem"]) + " " + rng.choice(["Orlo", "Minko", "Tarp"]) + rng.choice(["v", "x", "s"])
    return rng.choice(SENTENCES).format(name(), rng.randrange(100, 999), name())


def test_sources(spark):
    rng = random.Random(3)
    rows, truth, total = [], set(), {}
    for k in range(4000):
        source = rng.choice(["field", "stream", "terse", None])
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.1:
            text = text + rng.choice(["\nLabel: GOOD", " - verdict: keep", " [3]"])
        if source == "terse":
            text = rng.choice(["correct entity, wrong year", "query too broad, repeats step 4"])
            cut = rng.random() < 0.03
            text = text[: rng.randrange(4, len(text) - 3)] if cut else text
        elif source == "field":
            cut = len(text) > 180
            text = text[:180]
        else:
            cut = rng.random() < 0.05
            text = text[: rng.randrange(20, len(text) - 12)] if cut else text
        if cut and not text.rstrip().endswith((".", "!", "]", "keep", "GOOD")):
            truth.add(k)
        rows.append((k, source, text, "x"))
    rows += [(9000, "stream", None, ""), (9001, "stream", "", ""), (9002, "stream", " - ", ""), (9003, "stream", "<think>It was sold.", ""), (9004, "stream", "<think>It was sold.</think>", ""), (9005, "field", "word " * 30000 + "end.", "")]
    truth.add(9003)
    t = Truncation(spark.createDataFrame(rows, "id long, src string, txt string, source string").repartition(3), "id", "src", "txt")
    found = {r.record for r in t.cut().collect()}
    assert len(found & truth) >= 0.95 * len(truth)
    assert len(found - truth) <= 0.05 * len(found)
    assert not found & {9000, 9001, 9002, 9004, 9005}
    limits = [(r.source, r.length) for r in t.limits().collect()]
    assert ("field", 180) in limits and all(s == "field" for s, _ in limits)
    shares = {r.source: r for r in t.by_source().collect()}
    assert set(shares) == {"field", "stream", "terse", None} and sum(r.n for r in shares.values()) == len(rows)


def test_repeated_rows_and_empty_table(spark):
    schema = "id long, src string, txt string"
    t = Truncation(spark.createDataFrame([(1, "a", "<think>cut"), (1, "a", "<think>cut")], schema), "id", "src", "txt")
    assert t.cut().count() == 2
    empty = Truncation(spark.createDataFrame([], schema), "id", "src", "txt")
    assert empty.cut().count() == 0 and empty.by_source().count() == 0
