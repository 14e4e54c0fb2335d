"""Evidence in a text's form that it stops before its end, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("think", "search", "answer", "documents", "REASONING")

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = r"(?:approx|ca|cf|vol|vols|no|nos|dr|mr|mrs|st|prof|fig|figs|ed|eds|pp|e\.g|i\.e|etc\. and|vs|resp|incl|bzw|z\.b|env|núm|aprox)"
# Words that begin or go on with a sentence and so are no bare answer.
SENTENCE_WORDS = (
    "it so next both passage when if because in on at by as i we this that sorry for from with and but or its is was were be been cannot could would should since until after before while uses against sound said says "
    "el en los las una un después antes según cuando y que por la die das der ein eine nach vor im und le les une un après avant l d il elle nel secondo"
)


def count_of(text: Column, literal: str) -> Column:
    """How often ``literal`` stands in the text."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal))


TAIL = 48  # what is asked of a text's last characters needs no more of them


def tail_of(text: Column) -> Column:
    """The last TAIL characters, white space behind them cut off."""
    return F.right(F.rtrim(text), F.lit(TAIL))


def unclosed(text: Column) -> Column:
    """A tag that is opened and not closed, or broken off within its brackets."""
    tail = F.right(text, F.lit(TAIL))
    broken = tail.rlike(r"<[/A-Za-z]*$|\[/[A-Z]*$")
    for tag in TAGS:
        left, right = "<>" if tag.islower() else "[]"
        # counted only in texts that have the tag at all
        opened = f"{left}{tag}{right}"
        broken = broken | (text.contains(opened) & (count_of(text, opened) > count_of(text, f"{left}/{tag}{right}")))
    return broken | (text.contains('="') & (text.rlike(r"[A-Za-z]\[[a-z]+=\"[^\"]*$") | text.rlike(r"\[[a-z]+=\"[^\"]*\"$")))


def open_quote(text: Column) -> Column:
    """An odd number of double quotes."""
    return count_of(text, '"') % 2 == 1


def stops_short(text: Column) -> Column:
    """The last words are in no tag, and no sentence end, bracket or quote closes them."""
    tail = tail_of(text)
    closed = tail.rlike(r"[.!?…。！？]['\"”»)\]]*$|[>\]}]$|[.!?…]\s*[)\"”»]$")
    abbreviation = F.lower(tail).rlike(r"(?:^|[\s(])" + ABBREVIATIONS + r"\.$")
    return ~closed | abbreviation


def bare_answer(text: Column) -> Column:
    """A name, number or yes/no that needs no full stop."""
    plain = F.trim(text)
    words = F.split(F.regexp_replace(plain, r"[.!?]$", ""), r"\s+")
    named = F.forall(words, lambda w: w.rlike(r"^(?:\p{Lu}.*|\p{N}.*|the|of|yes|no|none|and|sí|oui|non|ja|nein|[-–—.]+)$"))
    # most texts have more words, which the pattern sees at the eighth
    return plain.rlike(r"^\S*(?:\s+\S+){0,6}\s*$") & (F.size(words) <= 7) & named & ~F.lower(F.get(words, F.lit(0))).isin(*SENTENCE_WORDS.split())


def unfinished(text: Column) -> Column:
    """The text breaks off: an open tag or quote, or words without an end that are no bare answer.

    False for text without letters or digits.
    """
    wordy = text.rlike(r"[\p{L}\p{N}]")
    return wordy & (unclosed(text) | open_quote(text) | (stops_short(text) & ~bare_answer(text)))
