"""String columns: white space, the answer normalisers, sentences, truncation, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the full normaliser drops from answers.
TITLES = (
    "sir mr mrs ms dr prof professor president ceo cfo cto coo chairman chairwoman director mayor governor senator "
    "congressman congresswoman king queen prince princess duke duchess lord lady captain general colonel admiral"
).split()
ARTICLES = "a an the".split()
# ASCII punctuation, and the marks that the full normaliser adds.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EXTRA_MARKS = "´`"


def strip(text: Column) -> Column:
    """Without any Unicode white space at the ends (plain ``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def without_words(text: Column, listed: list[str]) -> Column:
    """Whole words of a list replaced by a space."""
    return F.regexp_replace(text, rf"\b(?:{'|'.join(listed)})\b", " ")


def normal_full(text: Column) -> Column:
    """N1: punctuation becomes space, then titles and articles go."""
    marks = PUNCTUATION + EXTRA_MARKS.replace("`", "")
    spaced = F.translate(F.lower(text), marks, " " * len(marks))
    return squeeze(without_words(without_words(spaced, TITLES), ARTICLES))


def normal_joined(text: Column) -> Column:
    """N2: punctuation is deleted, articles stay."""
    return squeeze(F.translate(F.lower(text), PUNCTUATION, ""))


def normal_bare(text: Column) -> Column:
    """N3: articles go first, then punctuation is deleted."""
    return squeeze(F.translate(without_words(F.lower(text), ARTICLES), PUNCTUATION, ""))


def normal_ascii(text: Column) -> Column:
    """N4: anything but ASCII letters, digits and white space becomes space."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))


def vote_key(text: Column) -> Column:
    """N5: what answers are counted by."""
    return F.lower(strip(text))


def question_id_of(trajectory_id: Column) -> Column:
    """The part before the last ``_sample_``; the whole id when there is none."""
    return F.regexp_replace(trajectory_id, r"(?s)^(.*)_sample_.*$", "$1")


def sample_index_of(trajectory_id: Column) -> Column:
    """The number behind the last ``_sample_``, null when there is none."""
    return F.regexp_extract(trajectory_id, r"(?s)_sample_(\d+)$", 1).try_cast("int")


def truncate_marked(text: Column, limit: int = 1200, mark: str = " [TRUNCATED]") -> Column:
    """Cut to ``limit`` characters with a mark where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def first_sentences(text: Column, n: int, fallback: int = 500) -> Column:
    """The first ``n`` sentences; the first ``fallback`` characters if there is no sentence."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+\s+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, n), ". ")).otherwise(F.substring(text, 1, fallback))


def position_score(index: Column) -> Column:
    """max(1 - 0.1 i, 0.1) for the i-th hit of a search, from 0."""
    return F.greatest(F.lit(1.0) - F.lit(0.1) * index, F.lit(0.1))


def bool_word(text: Column) -> Column:
    """"True" and "False" as yes and no."""
    return F.when(text == "True", "yes").when(text == "False", "no").otherwise(text)
