import random
import unicodedata
from collections import Counter

import pytest

import steploom.llm.overlap as overlap
from steploom.llm.overlap import SplitOverlap, content_words, edits, fingerprints, plain_answer, same_answer, same_question, typed_alike

SCHEMA = "id string, part string, src string, q string, a string, key long, seen boolean"


def test_words_and_typing():
    assert content_words("  Question: WHICH year was Château Orlo sold? Answer briefly.") == ["year", "chateau", "orlo", "sold"]
    assert plain_answer('"The Orlo Press."') == "orlo press" and plain_answer("9,595") == plain_answer("9595")
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abcdef", 2) == 3
    assert typed_alike("before", "befroe") and not typed_alike("1847", "1848") and not typed_alike("chess", "opera")
    assert same_answer("orlo press", "orlo perss") and not same_answer("1847", "1874")


@pytest.mark.parametrize(("a", "b", "same"), [
    ("According to the Orlo ledger, in which year was Minko Bay sold?", "In what year is Minko Bay sold, according to Orlo ledger", True),
    ("Who taught chess at Orlo Press?", "Who taught opera at Orlo Press?", False),
    ("Were both Tarpolin and Minkovar closed before 1957?", "Were both Tarpolin and Minkovar closed before 1958?", False),
    ("Where did Tarpolin Rovers go?", "[retry] please tell me: where did Tapolin  Rovers go ? Answer briefly.", True),
    ("Where did Tarpolin Rovers go?", "Where did Mibahamon Rovers go?", False),
])
def test_same_question(a, b, same):
    assert same_question(content_words(a), content_words(b)) is same


@pytest.mark.parametrize(("a", "b"), [("which car did Tarpolin buy", "which bar did Tarpolin buy"), ("who painted the cat", "who painted the hat"), ("where was Dan born", "where was Kan born"), ("who won in Lima", "who won in Lisa"), ("who owns the bar", "who owns the tie")])
def test_short_words_are_not_slips_of_each_other(a, b):
    assert not same_question(content_words(a), content_words(b))
    assert not same_answer("cat", "hat") and not same_answer("john smith", "joan smith")


def test_known_words_are_not_slips_of_each_other():
    a, b = content_words("which painter left"), content_words("which painted left")
    assert same_question(a, b, frozenset({"painter"})) and not same_question(a, b, frozenset({"painter", "painted"}))


@pytest.mark.parametrize("text", ["Où fut né Zoë—à l'École?", "¿Quién fundó 1,234 años después?", "Straße Łódź ½ ﬁne № 5", "Ωmega Привет 東京", "naïve café “x” e\u0301", "a\u00ada ٣٤ x", ""])
def test_words_are_the_same_on_the_short_way(text):
    flat = "".join(c for c in unicodedata.normalize("NFKD", overlap.regex.sub(r"(?<=\p{N}),(?=\p{N}{3}(?!\p{N}))", "", text).casefold()) if not unicodedata.combining(c))
    assert overlap.words_of(text) == overlap.regex.findall(r"[\p{L}\p{M}\p{N}]+", flat)


def test_fingerprints_do_not_depend_on_batch_or_order():
    texts = [content_words(t) for t in ("Where did Tarpolin Rovers go?", "Go where Rovers did Tarpolin", "x", "")]
    texts[3] = []
    prints = fingerprints(texts * 300, frozenset({"where"}))
    assert (prints[:4] == prints[-4:]).all() and (prints[0] == prints[1]).all() and not prints[3].any()


def slip(rng, text):
    k = rng.randrange(1, len(text) - 2)
    return rng.choice([text[:k] + text[k + 1] + text[k] + text[k + 2 :], text[:k] + text[k + 1 :], text[:k] + text[k] + text[k:]])


def table(seed, n=400):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows = []
    for k in range(n):
        a, b, year = name(), name(), rng.randrange(1700, 1999)
        q = rng.choice([f"According to the {name()} ledger, in which year was {a} Bay sold to {b} Press?", f"Were both {a} Guild and {b} Fen closed before {year}?", f"Who taught chess at {a} Abbey together with {b} Rovers?"])
        answer = str(year) if "ledger" in q else rng.choice(["yes", "no"]) if "both" in q else f"{name()} {name()}"
        rows.append((f"t{k}", rng.choice(["train"] * 4 + ["validation", "test"]), "s", q, answer))
        for j in range(rng.choice([0, 0, 0, 1, 2])):
            text = rng.choice([q, q.upper(), slip(rng, q), f"Question: {slip(rng, slip(rng, q))}", q.replace("the ", "")])
            rows.append((f"t{k}_{j}", rng.choice(["train", "validation", "test", None]), "s", text, rng.choice([answer, answer.upper() + ".", f'"{answer}"', None, "other thing"])))
    return rows


def test_against_all_pairs(spark):
    rows = table(3)
    rows += rows[:20] + [("n1", "train", "s", None, "yes"), ("n2", None, "s", "Q?", "yes"), (None, "train", "s", "Q?", "yes"), ("e1", "train", "s", "", "x"), ("e2", "test", "s", "", "x"), ("l1", "train", "s", "long " * 5000 + "Tarpolin", "z"), ("l2", "test", "s", "long " * 5000 + "Tarpoiln", "z")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA).repartition(4)
    o = SplitOverlap(df, "id", "part", "src", "q", "a")
    usable = [(i, p == "train", content_words(q), plain_answer(a)) for i, p, _, q, a in set(rows) if None not in (i, p, q, a) and content_words(q) and plain_answer(a)]
    questions = {(tuple(q), a) for _, _, q, a in usable}
    times = Counter(w for q, _ in questions for w in set(q))
    known = frozenset(w for w, n in times.items() if n >= overlap.KNOWN)
    want = {(min(i, j), max(i, j)) for i, s, q, a in usable for j, t, r, b in usable if s and not t and same_answer(a, b) and same_question(q, r, known)}
    got = {tuple(r) for r in o.pairs("a", "b").collect()}
    assert not got - want
    assert len(got) >= 0.97 * len(want)
    by = o.by_split().collect()
    assert sum(r.n_records for r in by) == len({i for i, s, *_ in usable if not s})
    assert sum(r.n_overlapping for r in by) >= 0.97 * len({j for p in want for j in p if j in {i for i, s, *_ in usable if not s}})


def test_large_classes_are_stars_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(overlap, "EXPAND", 2)
    rows = [(f"t{k}", "train", "s", "Where did Tarpolin go?", "Orlo", 1, True) for k in range(4)] + [(f"v{k}", "test", "s", "Where did Tarpolin go", "orlo", 1, True) for k in range(3)]
    got = {tuple(r) for r in SplitOverlap(spark.createDataFrame(rows, SCHEMA), "id", "part", "src", "q", "a").pairs("a", "b").collect()}
    assert got == {(f"t{k}", "v0") for k in range(4)} | {("t0", f"v{k}") for k in range(3)}
    assert SplitOverlap(spark.createDataFrame([], SCHEMA), "id", "part", "src", "q", "a").pairs("a", "b").count() == 0
