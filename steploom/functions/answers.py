"""Answer comparison: token F1 in its three forms, exact and cover match, answer extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from steploom.functions.text import bool_word, normal_bare, normal_full, normal_joined, strip, words

YES_NO = ("yes", "no", "noanswer")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""

    def times(array: Column, token: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == token))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(times(a, t), times(b, t)))


def overlap_scores(prediction: Column, gold: Column) -> Column:
    """struct(f1, precision, recall) of two normalised strings; zeros without a common token."""
    p, g = _tokens(prediction), _tokens(gold)
    same = common_tokens(p, g)
    some = same > 0
    precision, recall = F.try_divide(same, F.size(p)), F.try_divide(same, F.size(g))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    zero = F.lit(0.0)
    return F.struct(F.when(some, f1).otherwise(zero).alias("f1"), F.when(some, precision).otherwise(zero).alias("precision"), F.when(some, recall).otherwise(zero).alias("recall"))


def _guarded(p: Column, g: Column) -> Column:
    """Whether a yes/no answer meets a different one."""
    return (p.isin(*YES_NO) | g.isin(*YES_NO)) & (p != g)


def f1_full(prediction: Column, gold: Column) -> Column:
    """F1a: booleans mapped, yes/no guarded, fully normalised; struct(f1, precision, recall)."""
    p, g = normal_full(bool_word(prediction)), normal_full(bool_word(gold))
    none = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return F.when(_guarded(p, g), none).otherwise(overlap_scores(p, g))


def f1_reward(prediction: Column, gold: Column) -> Column:
    """F1b: yes/no guarded, punctuation deleted; the reward in search trees."""
    p, g = normal_joined(prediction), normal_joined(gold)
    return F.when(_guarded(p, g), F.lit(0.0)).otherwise(overlap_scores(p, g)["f1"])


def f1_board(prediction: Column, gold: Column) -> Column:
    """F1c: no guard, articles dropped; the score of leaderboards."""
    return overlap_scores(normal_bare(prediction), normal_bare(gold))["f1"]


def exact_match(prediction: Column, gold: Column) -> Column:
    """Equal after full normalisation."""
    return normal_full(bool_word(prediction)) == normal_full(bool_word(gold))


def cover_tokens(prediction: Column, gold: Column) -> Column:
    """Every gold token in the prediction; a yes/no gold must be its first token. Empty gold covers."""
    gold = normal_full(bool_word(gold))
    p, g = _tokens(normal_full(bool_word(prediction))), _tokens(gold)
    return F.when(gold.isin(*YES_NO), F.coalesce(F.get(p, F.lit(0)) == gold, F.lit(False))).otherwise(F.size(F.array_except(g, p)) == 0)


def cover_phrase(prediction: Column, gold: Column) -> Column:
    """The gold answer as a substring of the prediction; where either is yes/no, both must be equal."""
    p, g = normal_full(bool_word(prediction)), normal_full(bool_word(gold))
    return F.when(g.isin(*YES_NO) | p.isin(*YES_NO), p == g).otherwise(p.contains(g))


def _both_ways(p: Column, g: Column) -> Column:
    return (p != "") & (g != "") & (p.contains(g) | g.contains(p))


def match_either(prediction: Column, gold: Column) -> Column:
    """V2: one lower-case string contains the other, neither empty."""
    return F.coalesce(_both_ways(F.lower(strip(prediction)), F.lower(strip(gold))), F.lit(False))


def match_unquoted(prediction: Column, gold: Column) -> Column:
    """V3: as V2, tried again without quotation marks."""
    p, g = F.lower(strip(prediction)), F.lower(strip(gold))
    bare = [strip(F.translate(x, "\"'“”", "")) for x in (p, g)]
    return F.coalesce(_both_ways(p, g) | _both_ways(*bare), F.lit(False))


def match_contains(prediction: Column, gold: Column) -> Column:
    """V4: the lower-case gold answer stands in the prediction."""
    return F.coalesce(F.lower(strip(prediction)).contains(F.lower(strip(gold))), F.lit(False))


def match_strict(prediction: Column, golds: Column) -> Column:
    """V5: equal to one of the gold answers after N3."""
    return F.exists(golds, lambda g: normal_bare(prediction) == normal_bare(g))


def match_extracted(text: Column, gold: Column) -> Column:
    """V6: the answer extracted from a text covers the gold answer."""
    return cover_tokens(extract_answer(text), gold)


def best_of_golds(metric: Callable[[Column, Column], Column], prediction: Column, golds: Column) -> Column:
    """The highest value of a scalar or boolean metric over several gold answers."""
    return F.array_max(F.transform(golds, lambda g: metric(prediction, g)))


def best_f1_of_golds(prediction: Column, golds: Column) -> Column:
    """The full F1 struct of the gold answer with the highest F1, the first of equals."""
    scored = F.transform(golds, lambda g, i: F.struct(f1_full(prediction, g).alias("s"), (-i).alias("place")))
    ranked = F.array_max(F.transform(scored, lambda x: F.struct(x["s"]["f1"].alias("f1"), x["place"].alias("place"), x["s"].alias("s"))))
    return ranked["s"]


def all_metrics(prediction: Column, golds: Column) -> Column:
    """struct(em, f1, precision, recall, cover_tokens, cover_phrase) over several gold answers."""
    f1 = best_f1_of_golds(prediction, golds)
    return F.struct(
        best_of_golds(exact_match, prediction, golds).cast("int").alias("em"), f1["f1"].alias("f1"), f1["precision"].alias("precision"), f1["recall"].alias("recall"),
        best_of_golds(cover_tokens, prediction, golds).cast("int").alias("cover_tokens"), best_of_golds(cover_phrase, prediction, golds).cast("int").alias("cover_phrase"),
    )


def clean_span(text: Column) -> Column:
    """Without white space and brackets at the ends and full stops behind."""
    inner = F.regexp_replace(strip(text), r"(?U)^[()\s]+|[()\s]+$", "")
    return strip(F.regexp_replace(inner, r"\.+$", ""))


# Markers behind which a final answer is explained, in order of precedence.
EXPLANATIONS = (
    r"(?i)\s+(?:because|since|as|because of|due to|owing to|given that)\s+",
    r"(?i)\s+(?:which|that|who|where|when)\s+",
    r"(?i)[.,;]\s+(?:This|It|They|He|She|The)",
)
# Phrasings of an answer. The end is a stop before a word, a semicolon or a reason;
# matched without case, the look-behind lets no stop behind a letter count.
_END = r"(?:(?<![A-Z])\.(?=\s+[A-Z])|[;]|\s+(?:because|since)\s+|$)"
PHRASINGS = (
    r"(?is)therefore,?\s+(?:the\s+answer\s+is\s*:?\s*)?(.+?)" + _END,
    r"(?is)(?:the\s+)?answer\s+is\s*:?\s*(.+?)" + _END,
    r"(?is)(?:in\s+)?conclusion,?\s+(.+?)" + _END,
)
# Openings of lines that are no answer.
NO_ANSWER_LINES = ("intermediate answer", "missing info", "next query target")


def _filled(text: Column) -> Column:
    """Null for an empty string, so that a coalesce goes on."""
    return F.nullif(text, F.lit(""))


def _first_line(lines: Column) -> Column:
    return F.get(F.filter(F.transform(lines, clean_span), lambda x: x != ""), F.lit(0))


def _final_answer(text: Column) -> Column:
    rest = strip(F.regexp_extract(text, r"(?is)final\s+answer\s*:?\s*(.+)", 1))
    # the first marker of the list that occurs decides, wherever it stands
    cut = F.coalesce(*(F.when(rest.rlike(m), strip(F.get(F.split(rest, m, 2), F.lit(0)))) for m in EXPLANATIONS), rest)
    sentence = _filled(strip(F.regexp_extract(cut, r"^([^.!?]+)[.!?]", 1)))
    short = F.when(F.size(words(cut)) > 15, F.coalesce(sentence, F.array_join(F.slice(words(cut), 1, 10), " "))).otherwise(cut)
    return F.coalesce(_first_line(F.split(short, r"\R")), _filled(clean_span(short)))


def extract_answer(text: Column) -> Column:
    """The most plausible answer in a model's output, '' if there is none.

    In order: an answer tag, a Finish action, what follows "final answer", three phrasings, a
    bracket at the end, the first line that is none of the known openings. A level that leaves
    nothing after cleaning gives way to the next.
    """
    text = strip(F.coalesce(text, F.lit("")))
    tag = _filled(clean_span(F.regexp_extract(text, r"(?s)<answer>(.+?)</answer>", 1)))
    finish = _filled(clean_span(F.regexp_extract(text, r"(?is)(?:Action:\s*)?Finish\[answer\s*=\s*[\"'](.+?)[\"']\]", 1)))
    phrased = [_filled(clean_span(F.regexp_extract(text, p, 1))) for p in PHRASINGS]
    bracket = _filled(clean_span(F.regexp_extract(text, r"\(([^)]+)\)[.,;]?\s*$", 1)))
    plain = F.filter(F.split(text, r"\R"), lambda x: (strip(x) != "") & ~F.lower(strip(x)).rlike("^(?:" + "|".join(NO_ANSWER_LINES) + ")"))
    return F.coalesce(tag, finish, _final_answer(text), *phrased, bracket, _first_line(plain), F.lit(""))
