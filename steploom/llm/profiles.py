"""Language of prose by character trigram profiles, fitted on labelled texts.

A profile has for every trigram the log odds of standing in a text of the language. Words that are
capitalised within a sentence are left out, as names are alike in all languages; trigrams are hashed to
2 ** BITS places. A wrong label here and there doesn't matter, as a profile counts texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
SAMPLE = 8000  # labelled texts that profiles are fitted on, by hash order
LEAST_TEXTS = 20  # of a language, to have a profile
LEAST_TRIGRAMS = 20  # of an answer; a bare name has no language
MARGIN = 6.0  # log odds by which another language must lead

SAME, DIFFERENT, UNCLEAR = 0, 1, 2

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?]")


def plain_words(text: str) -> str:
    """Lower-case words without those that are capitalised within a sentence, between single spaces."""
    out, first = [], True
    for token in _TOKEN.findall(text):
        if token in ".!?":
            first = True
            continue
        if first or not token[0].isupper():
            out.append(token.lower())
        first = False
    return f" {' '.join(out)} "


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the plain words of all texts, and how many each text has."""
    plain = [plain_words(t) for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(len(plain), np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(points), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[inside[:-2]], np.maximum(sizes - 2, 0)


class Profiles:
    """Profiles of the languages that at least LEAST_TEXTS of the sampled texts are labelled with."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.languages = sorted(n for n, k in Counter(name for name, _ in labelled).items() if k >= LEAST_TEXTS)
        counts = np.zeros((len(self.languages), 1 << BITS))
        total = np.zeros(len(self.languages))
        for k, language in enumerate(self.languages):
            grams, sizes = trigrams([t for n, t in labelled if n == language])
            places = np.unique(np.repeat(np.arange(len(sizes)), sizes) << BITS | grams)  # once a text
            counts[k] = np.bincount(places & ((1 << BITS) - 1), minlength=1 << BITS)
            total[k] = len(sizes)
        odds = np.log((counts + 0.3) / (total[:, None] + 1))
        self.odds = np.ascontiguousarray((odds - odds.mean(0)).T.astype(np.float32)) if len(self.languages) else np.zeros((1 << BITS, 0), np.float32)

    @classmethod
    def fit(cls, df: DataFrame, text: str, language: str, sample: int = SAMPLE) -> Profiles:
        """From a bounded sample of the rows that have a language and 40 characters of text."""
        rows = df.select(F.col(language).alias("l"), F.col(text).alias("t")).where("l is not null")
        # about as many rows as are wanted pass the hash, so that no task sends more than its share
        share = min(1.0, 1.2 * sample / max(1, rows.count()))
        picked = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) <= int(share * (1 << 30))).where("length(t) >= 40")
        return cls([tuple(r) for r in picked.orderBy(F.xxhash64("t"), "l").limit(sample).collect()])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages log odds, trigrams of each text)."""
        grams, sizes = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        on = np.flatnonzero(sizes)
        if len(on) and self.languages:
            out[on] = np.add.reduceat(self.odds[grams], (np.cumsum(sizes) - sizes)[on], axis=0)
        return out, sizes

    def compare(self, questions: list[str], answers: list[str]) -> np.ndarray:
        """Per pair DIFFERENT, SAME or UNCLEAR: the languages of question and answer.

        They differ if the answer's language leads the question's in the answer by MARGIN, and the
        other way round in the question. A question that doesn't say its own language by as much, as
        short ones may, and an answer of few trigrams leave it open.
        """
        asked, n_asked = self.scores(questions)
        told, n_told = self.scores(answers)
        if len(self.languages) < 2:
            return np.full(len(questions), UNCLEAR)
        own, best = asked.argmax(1), told.argmax(1)
        row = np.arange(len(own))
        rival = np.sort(asked, axis=1)[:, -2]
        known = (n_asked > 0) & (n_told >= LEAST_TRIGRAMS) & (asked[row, own] - rival > MARGIN)
        other = (own != best) & (told[row, best] - told[row, own] > MARGIN)
        return np.where(~known, UNCLEAR, np.where(other, DIFFERENT, SAME))
