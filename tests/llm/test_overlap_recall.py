"""Pairs that frequent answers or answers of certain lengths must not cost."""

import random

import steploom.llm.overlap as overlap
from steploom.llm.overlap import SplitOverlap, content_words, fingerprints, same_question

SCHEMA = "id string, part string, src string, q string, a string"


def found(spark, rows):
    return {tuple(r) for r in SplitOverlap(spark.createDataFrame(rows, SCHEMA), "id", "part", "src", "q", "a").pairs("a", "b").collect()}


def one_block_pairs(n):
    """Questions that agree but for slips, in exactly one block of their fingerprints."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    out = []
    while len(out) < n:
        a = f"were {name()} guild and {name()} closed before {rng.randrange(1700, 1999)}"
        k = rng.randrange(5, 12)
        b = a[:k] + a[k + 1] + a[k] + a[k + 2 :]
        x, y = content_words(a), content_words(b)
        prints = fingerprints([x, y], frozenset())
        apart = int.from_bytes(prints[0].tobytes()) ^ int.from_bytes(prints[1].tobytes())
        if apart.bit_count() <= overlap.RADIUS and (prints[0] == prints[1]).sum() == 1 and same_question(x, y):
            out.append((a, b))
    return out


def test_frequent_answers_cost_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 1.0)
    rows = [(f"{side}{k}", part, "s", q, "yes") for k, pair in enumerate(one_block_pairs(5)) for side, part, q in zip("tv", ("train", "test"), pair, strict=True)]
    assert found(spark, rows) == {(f"t{k}", f"v{k}") for k in range(5)}


def test_digits_divide_no_pair():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice(["19", "57", "1957", "orlo", "orol", "bay", "5x", "the", "teh"]) for _ in range(rng.randrange(1, 5))]
        b = [rng.choice(["19", "57", "1957", "orlo", "orol", "bay", "5x", "the", "teh"]) for _ in range(rng.randrange(1, 5))]
        if same_question(a, b):
            assert overlap.digits_of(" ".join(a)) == overlap.digits_of(" ".join(b))


def slipped(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcxyz") + word[k:], word[:k] + rng.choice("abcxyz") + word[k + 1 :], word[:k] + word[k + 1 : k + 2] + word[k] + word[k + 2 :]])


def test_same_answers_share_a_key():
    rng, met = random.Random(8), 0
    for _ in range(6000):
        words = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 10, 11, 24, 25, 26, 27, 40]))) for _ in range(rng.randrange(1, 4))]
        k, a = rng.randrange(len(words)), " ".join(words)
        for _ in range(rng.choice([1, 2])):
            words[k] = slipped(rng, words[k]) or "a"
        b = rng.choice([" ", " ", ""]).join(words)
        if overlap.same_answer(a, b):
            met += 1
            assert set(overlap.answer_keys(a)) & set(overlap.answer_keys(b)), (a, b)
    assert met > 2000


def test_slips_across_answer_lengths(spark):
    answers = [("orlo bayins", "orlo bayyins"), ("minkov", "mminkov"), ("orlo", "olro"), ("tarpolinas", "atrpolinsa"), ("a" * 12 + "b" * 13, "a" * 11 + "b" * 13)]
    assert all(overlap.same_answer(*x) for x in answers)
    rows = [(f"{side}{k}", part, "s", f"Where did Tarpolin Rovers number {k} go?", a) for k, pair in enumerate(answers) for side, part, a in zip("tv", ("train", "test"), pair, strict=True)]
    assert found(spark, rows) == {(f"t{k}", f"v{k}") for k in range(len(answers))}


def test_slips_of_frequent_words_cost_no_pair_as_tables_grow(spark):
    """A slip that recurs is no word of its own beside one that is a hundred times as frequent."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5))
    rows = [(f"n{k}", "train", "s", f"who moved to {name()} railway from {name()}", name()) for k in range(900)]
    want = set()
    for k in range(15):  # each slip five times
        x, y, a = name(), name(), name()
        q = [f"who moved to {x} raiwlay from {y}", f"who moved tto {x} railway from {y}", f"who moved to te {x} railway from {y}"][k % 3]
        rows += [(f"t{k}", "train", "s", f"who moved to {x} railway from {y}", a), (f"v{k}", "test", "s", q, a)]
        want.add((f"t{k}", f"v{k}"))
    # words of one letter's difference that are about as frequent ask for different things
    for k in range(4):
        x, y, a = name(), name(), name()
        rows += [(f"p{k}", "train", "s", f"which painter left {x} for {y}", a), (f"w{k}", "test", "s", f"which painted left {x} for {y}", a)]
        rows += [(f"r{k}", "train", "s", f"which ox left {x} near {y}", a), (f"s{k}", "test", "s", f"which fox left {x} near {y}", a)]
    assert found(spark, rows) == want


def test_short_words():
    assert all(overlap.short_slip(a, b) for a, b in (("to", "ot"), ("o", "to"), ("tto", "to"), ("he", "the"), ("si", "is")))
    assert not any(overlap.short_slip(a, b) for a, b in (("he", "te"), ("to", "to"), ("to", "do"), ("5", "55"), ("car", "bar"), ("o", "the"), ("dan", "an")))
    assert same_question(content_words("laut dem verzeichnis von orlo"), content_words("laut verzeichnis von orlo"))
