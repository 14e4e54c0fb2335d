"""Language of short prose by function words and script, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common function words of each language. Words that several of these languages or
# proper names share ("the", "of", "la", "in", "no") are left out.
WORDS = {
    "en": "and was were that is it be because so but for who which did from with before after than by have how not to both are when what where since its into until their they this there been has had will would could should must still out far",
    "es": "el los las del que fue una y por con su sus después antes según más como pero cuando quién qué año cómo dónde mientras cerca entre sobre hasta donde sí muy nunca esta este lo al",
    "fr": "le les des du et une fut par pour qui après avant dont au aux été est avec dans sur ou mais cette ce ses selon quelle quel jamais plus elle ils sont pas ne lors chez",
    "de": "der die das und wurde ein eine von nach für den dem des ist im mit zu sagt ja jemals wer welchem vor zusammen heute liegt davon nicht auch als auf sich sie wir aus über laut hatte bei zum zur",
    "it": "il della del nel venne per una che dopo lo gli fu di secondo quindi questa è sono con ma non più alla dal nella degli",
    "pt": "o os uma não em do da foi para depois com pelo pela segundo mais seu sua dos das ao que quando onde",
    "nl": "het een van werd naar niet de en dat die zijn door voor met ook maar bij aan uit",
}
# Unicode scripts that name a language group on their own.
SCRIPTS = {"zh": r"\p{IsHan}", "ru": r"\p{IsCyrillic}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "ar": r"\p{IsArabic}", "he": r"\p{IsHebrew}", "el": r"\p{IsGreek}", "hi": r"\p{IsDevanagari}", "th": r"\p{IsThai}"}


LANGUAGES = (*WORDS, *SCRIPTS)


def function_words(text: Column) -> Column:
    """The words of a text that are in any list. To be made a column of its own, as it is read once a language."""
    known = sorted({w for listed in WORDS.values() for w in listed.split()})
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*known))


def foreign_letters(text: Column) -> Column:
    """The letters of any of SCRIPTS, '' for most texts. To be made a column of its own, as it is read once a script."""
    every = "[" + "".join(s.strip("[]") for s in SCRIPTS.values()) + "]"
    # ASCII, and then a plain range, tell nearly all texts apart before any script is looked up
    other = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{370}-\x{1FFF}\x{2E80}-\x{10FFFF}]")
    return F.when(other, F.array_join(F.regexp_extract_all(text, F.lit(f"({every}+)"), F.lit(1)), "")).otherwise("")


def language_scores(found: Column, foreign: Column) -> Column:
    """Evidence for each of LANGUAGES: function words (``found``), or a quarter of the letters of its script (``foreign``)."""

    def listed(words: str) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*words.split())))

    scores = [listed(w) for w in WORDS.values()]
    for script in SCRIPTS.values():
        letters = F.length(F.regexp_replace(foreign, rf"(?:(?!{script})[\s\S])+", ""))
        scores.append(F.when(foreign != "", F.floor(letters / 4)).otherwise(0).cast("int"))
    return F.array(*scores)


def best_language(scores: Column, least: int = 1) -> Column:
    """Place in LANGUAGES of the highest score (the first of equals), null below ``least``."""
    top = F.array_max(scores)
    return F.when(top >= least, F.array_position(scores, top).cast("int"))
