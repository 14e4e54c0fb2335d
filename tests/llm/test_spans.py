import random

import numpy as np
import pytest

import steploom.llm.spans as spans
from steploom.llm.recompress import CONTEXT, EDGE, Powers, Sequence, Symbols, Texts, anchors
from steploom.llm.spans import SharedSpans


def brute(rows, span):
    """Pairs and covered counts by looking at every window."""
    where = {}
    for d, t in rows:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], []).append((d, i))
    pairs, cover = set(), {}
    for group in where.values():
        ids = {d for d, _ in group}
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for d, i in group:
                cover.setdefault(d, set()).update(range(i, i + span))
    return pairs, {d: len(c) for d, c in cover.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéж漢 ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    pool = [text(60) for _ in range(6)] + ["x" * 400, "ab" * 150, " " * 130]
    rows = []
    for d in range(90):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(max(1, len(p) - 100))
            parts += [p[a : a + rng.choice([60, 99, 100, 101, 139, 140, 141, 250])], text(rng.randrange(8))]
        rows.append((d, "".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(8)] + [(200, None), (201, ""), (202, "z" * 99)]
    return rows


@pytest.mark.parametrize("pairwise", [64, 2])
def test_against_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(spans, "PAIRWISE", pairwise)  # 2: nearly all classes go the way of large ones
    rows = corpus(5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, name string").repartition(5)
    s = SharedSpans(df, "doc_id", "text")
    pairs, cover = brute(rows, 100)
    assert {tuple(r) for r in s.pairs("a", "b").collect()} == pairs
    assert {r.doc: r.shared for r in s.covered().collect()} == cover


def test_large_copy_class_is_a_star(spark, monkeypatch):
    monkeypatch.setattr(spans, "EXPAND", 3)
    rows = [(k, "q" + "lorem ipsum " * 20) for k in range(5)] + [(9, "w" + "lorem ipsum " * 20)]
    got = {tuple(r) for r in SharedSpans(spark.createDataFrame(rows, "d long, t string"), "d", "t").pairs("a", "b").collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 9)}
    assert SharedSpans(spark.createDataFrame(rows, "d long, t string"), "d", "t").copies().count() == 5


def test_crowds_are_stars(spark, monkeypatch):
    monkeypatch.setattr(spans, "PAIRWISE", 2)
    monkeypatch.setattr(spans, "CROWD", 5)
    header = "the same licence header of more than a hundred characters stands in front of each of these many files. "
    rows = [(k, header + f"body {k} " * 5) for k in range(9)] + [(50, "x" + header[:101]), (51, "nothing in common with the others")]
    s = SharedSpans(spark.createDataFrame(rows, "d long, t string"), "d", "t")
    got = {tuple(r) for r in s.pairs("a", "b").collect()}
    linked = {x for p in got for x in p}
    assert linked == {*range(9), 50} and len(got) < 45
    assert {r.doc for r in s.crowds().collect()} == linked


def test_empty(spark):
    df = spark.createDataFrame([], "d long, t string")
    assert SharedSpans(df, "d", "t").pairs("a", "b").count() == 0


def named_anchors(text):
    block, powers = Texts([text]), Powers()
    parsed = Symbols(block, powers)
    p = anchors(block, parsed, 100)
    names = [parsed.chain(p, CONTEXT - EDGE, CONTEXT - EDGE)]
    for least, most in spans.places(100):
        names.append(np.where((p >= least) & (len(text) - p >= 100 - most), parsed.chain(np.clip(p, least, max(least, len(text) - 100 + most)), least - EDGE, 100 - most - EDGE), 0))
    return dict(zip(p.tolist(), zip(*(n.tolist() for n in names), strict=True), strict=True)), parsed


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "x", "xxxxxxxxxxxxxxxxxxxxxxy", "aab"])
def test_every_stretch_has_a_shared_anchor_of_one_name(alphabet):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(60):
        core = some(100)
        texts = [some(rng.randrange(80)) + core + some(rng.randrange(80)) for _ in range(2)]
        found = []
        for t in texts:
            at = t.index(core)
            names, _ = named_anchors(t)
            inside = {}
            for p, n in names.items():
                if CONTEXT <= p - at <= 100 - CONTEXT:
                    part = next(k for k, (least, most) in enumerate(spans.places(100)) if least <= p - at <= most)
                    inside[p - at] = (n[0], n[1 + part])
            found.append(inside)
        assert set(found[0].items()) & set(found[1].items())


def test_levels_make_symbols_and_anchors_rare():
    text = corpus(9)[0][1] + " ".join(f"the {k * 7919 % 1000} houses of number {k * k % 911}" for k in range(400))
    names, parsed = named_anchors(text)
    assert len(parsed.middle) < 0.6 * len(text) and len(parsed.high) < 0.3 * len(text) and len(names) < 0.06 * len(text)
    assert np.diff(parsed.middle).max() <= 4


def test_names_do_not_depend_on_place():
    s = Sequence(np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 3], np.uint32), Powers())
    names = s.names(np.array([0, 3, 7]), np.array([3, 6, 10]))
    assert names[0] == names[1] == names[2]
