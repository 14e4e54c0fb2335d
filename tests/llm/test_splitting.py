import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steploom.llm.components import components
from steploom.llm.splitting import Flow, GroupedSplit, quotas

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
RECORDS = "entity_a string, entity_b string, positive boolean, component string"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)]
    edges += [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)] + [("hub", f"s{k}") for k in range(200)] + [("x", None), (None, None), ("y", "y")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == union_find(edges)


def test_flow_finds_the_cheapest_way():
    f = Flow(4)
    f.add(0, 1, 2, 1.0), f.add(0, 2, 2, 2.0), f.add(1, 3, 1, 1.0), f.add(2, 3, 2, -1.0), f.add(1, 2, 1, 0.0)
    assert f.send(0, 3, 3) == pytest.approx(0 + 1 + 2)  # 0-1-2-3, 0-2-3, 0-1-3
    g = Flow(4)
    g.add(0, 1, 1, 0.0), g.add(0, 2, 1, 0.0), g.add(1, 3, 1, 5.0), g.add(2, 3, 1, 1.0)
    assert g.send(0, 3, 1) == 1.0


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3), st.integers(1, 200)), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_quotas_are_whole_and_near(spec):
    bundles = [(float(s), float(min(g, s)), n) for s, g, n in spec]
    out = quotas(bundles, [0.8, 0.1, 0.1])
    assert all(sum(row) == n and min(row) >= 0 for row, (_, _, n) in zip(out, bundles, strict=True))
    total = sum(s * n for s, _, n in bundles)
    largest = max(s for s, _, _ in bundles)
    for j, p in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(s * row[j] for row, (s, _, _) in zip(out, bundles, strict=True)) - p * total) <= 1.5 * largest
    assert quotas(bundles, [1.0, 0.0]) == [[n, 0] for _, _, n in bundles]


def test_split(spark):
    rng = random.Random(2)
    rows = [("hot", f"t{rng.randrange(3)}", True, "x") for _ in range(1500)]
    for k in range(900):
        a, b = f"q{k}", f"q{k}" if rng.random() < 0.9 else f"q{rng.randrange(900)}"
        rows += [(a if rng.random() < 0.9 else None, b, rng.random() < 0.5, "x") for _ in range(rng.choice([1, 2, 2, 3, 9]))]
    rows += [(None, None, True, "x")] * 3
    targets = spark.createDataFrame(TARGETS, "split_name string, proportion double")
    s = GroupedSplit(spark.createDataFrame(rows, RECORDS).repartition(3), targets)
    split = {r.entity: r.split for r in s.assignment().collect()}
    for a, b, *_ in rows:
        if a and b:
            assert split[a] == split[b]
    counts = {n: 0 for n, _ in TARGETS}
    for a, b, *_ in rows:
        if a or b:
            counts[split[a or b]] += 1
    total = sum(counts.values())
    for n, p in TARGETS:
        assert counts[n] / total == pytest.approx(p, abs=0.004)
    roots = union_find([(a, b) for a, b, *_ in rows])
    want = {(x, y) for x in roots for y in roots if x < y and roots[x] == roots[y]}
    assert {tuple(r) for r in s.linked_pairs("a", "b").collect()} == want
    assert {tuple(r) for r in s.linked_pairs("a", "b", expand=1).collect()} == {(roots[x], x) for x in roots if roots[x] != x}


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "split_name string, proportion double")
    s = GroupedSplit(spark.createDataFrame([], RECORDS), targets)
    assert s.assignment().count() == 0 and s.linked_pairs("a", "b").count() == 0
