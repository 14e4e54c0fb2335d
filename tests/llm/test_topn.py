import random

from hypothesis import given, settings
from hypothesis import strategies as st

from steploom.llm.topn import LoserTree, merge_runs, top_n_per_group


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or s != s:
            continue
        best[g, i] = max(best.get((g, i), float("-inf")), s)
    out = []
    for g in {g for g, _ in best}:
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(order[:n])]
    return sorted(out)


@given(st.lists(st.lists(st.integers(0, 9)), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    out = []
    while tree.keys[tree.winner] is not None:
        w = tree.winner
        out.append(tree.keys[w])
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_past_complete_groups():
    runs = [(["a", "a", "b"], [3.0, 2.0, 1.0], ["x", "y", "z"]), (["a", "a"], [3.0, 2.5], ["w", "x"])]
    assert list(merge_runs(runs, 2)) == [("a", "w", 3.0, 1), ("a", "x", 3.0, 2), ("b", "z", 1.0, 1)]


def test_hot_group_ties_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", f"g{rng.randrange(50)}", None]), rng.choice([f"t{rng.randrange(300)}", None, ""]), rng.choice([0.5, 0.25, rng.random(), None, float("nan")])) for _ in range(5000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "grp string, item string, score double, g string, bucket int")
    got = sorted(tuple(r) for r in top_n_per_group(df.repartition(7), "grp", "score", "item", 3, run_rows=100).collect())
    assert got == brute(rows, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "grp string, item string, score double")
    assert top_n_per_group(df, "grp", "score", "item", 3).count() == 0
