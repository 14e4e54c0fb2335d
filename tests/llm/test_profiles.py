import random

import numpy as np

from steploom.llm.pairs import broken_sides
from steploom.llm.profiles import DIFFERENT, LEAST_TRIGRAMS, UNCLEAR, Profiles, plain_words, trigrams

WORDS = {
    "en": "the year when it was sold to that house and nobody knew which of them had left before".split(),
    "fr": "la maison fut vendue après cette année et personne ne savait lequel était parti avant".split(),
    "es": "la casa fue vendida después de aquel año y nadie supo cuál había salido antes".split(),
}


def prose(rng, language, n=25):
    names = ["Orlo", "Minkovar", "Tarpolin"]
    return "Minko " + " ".join(rng.choice(names) if rng.random() < 0.3 else rng.choice(WORDS[language]) for _ in range(n)) + "."


def profiles(rng):
    labelled = [(k, prose(rng, k)) for k in WORDS for _ in range(40)]
    labelled += [("fr", prose(rng, "en")) for _ in range(3)] + [("xx", "rare label")]
    return Profiles(labelled)


def test_names_are_left_out_and_texts_kept_apart():
    assert plain_words("It left Orlo. Then l'École d'Orlo 12!") == " it left then l'école d'orlo "
    grams, sizes = trigrams(["ab", "", "abc"])
    assert sizes.tolist() == [2, 0, 3] and len(grams) == 5
    assert trigrams([""])[1].tolist() == [0] and len(trigrams(["", ""])[0]) == 0


def test_languages_are_told_apart():
    rng = random.Random(4)
    p = profiles(rng)
    assert p.languages == ["en", "es", "fr"]
    for own in WORDS:
        for other in WORDS:
            questions, answers = zip(*((prose(rng, own, 9), prose(rng, other)) for _ in range(30)), strict=True)
            share = (p.compare(list(questions), list(answers)) == DIFFERENT).mean()
            assert share >= 0.95 if own != other else share <= 0.05
    assert p.compare(["the year when it was sold"], ["Maison"])[0] == UNCLEAR and len("maison") < LEAST_TRIGRAMS
    assert p.compare(["", "x"], ["", ""]).tolist() == [UNCLEAR, UNCLEAR]
    assert Profiles([]).compare(["a"], ["b"]).tolist() == [UNCLEAR] and np.isfinite(p.odds).all()


def test_pairs_by_profiles(spark):
    rng = random.Random(5)
    p = profiles(rng)
    rows = [(1, "which year was it sold to that house", prose(rng, "en"), prose(rng, "fr")), (2, "which year was it sold to that house", None, "Орло покинул дом после забастовки и основал маленькую школу."), (3, None, prose(rng, "es"), "")]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")
    got = {(r.pair_id, r.side, r.defect) for r in broken_sides(df, "pair_id", "prompt", ["chosen", "rejected"], p).collect()}
    assert got == {(1, "rejected", "other_language"), (2, "chosen", "empty"), (2, "rejected", "other_language"), (3, "rejected", "empty")}
