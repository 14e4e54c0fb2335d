"""Spans and masks of training texts: steps, retrieved documents, prompt and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def starts_of(text: Column, marker: str) -> Column:
    """Places (from 0) at which a literal marker begins."""
    pieces = F.split(text, F.lit("\\Q" + marker + "\\E"), -1)
    sizes = F.transform(pieces, lambda p: F.length(p))
    total = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, x: a + x) + i * len(marker))
    return F.slice(total, F.lit(1), F.size(total) - 1)


def step_spans(text: Column) -> Column:
    """array<struct(start, end)>: from each ``<think>`` to the next or to the end."""
    starts = starts_of(text, "<think>")
    spans = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(starts, i + 1), F.length(text)).alias("end")))
    return F.filter(spans, lambda x: x["end"] > x["start"])


def document_spans(text: Column) -> Column:
    """array<struct(start, end)> of ``<documents>`` sections with their tags; an open one reaches the end."""
    starts, ends = starts_of(text, "<documents>"), starts_of(text, "</documents>")
    close = len("</documents>")

    def span(s: Column) -> Column:
        end = F.get(F.filter(ends, lambda e: e > s), F.lit(0))
        return F.struct(s.alias("start"), F.coalesce(end + close, F.length(text)).alias("end"))

    spans = F.transform(starts, span)
    # a start inside the span before it opens nothing new
    return F.filter(spans, lambda x, i: (i == 0) | (x["start"] >= F.get(F.transform(spans, lambda y: y["end"]), i - 1)))


def word_spans(text: Column) -> Column:
    """array<struct(start, end)> of the pieces between white space, by one fold that carries the place."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)(\s*\S+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        begin = end - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def inside(spans: Column, others: Column) -> Column:
    """Booleans: whether each span overlaps one of the others."""
    return F.transform(spans, lambda s: F.exists(others, lambda o: (s["start"] < o["end"]) & (s["end"] > o["start"])))


def label_mask(labels: Column, masked: Column, prompt_length: Column) -> Column:
    """Labels with IGNORED where they belong to the prompt or to a masked place."""
    return F.transform(labels, lambda x, i: F.when((i < prompt_length) | F.coalesce(F.get(masked, i), F.lit(False)), IGNORED).otherwise(x))


def padded(values: Column, width: Column, pad: int = IGNORED) -> Column:
    """An array filled up to a width."""
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(width - F.size(values), F.lit(0))))


def last_marker(text: Column, marker: str) -> Column:
    """Place (from 0) of a marker's last occurrence, -1 without one."""
    return F.coalesce(F.array_max(starts_of(text, marker)), F.lit(-1))


def masked_by_state(tokens: Column, opening: list[str], closing: list[str]) -> Column:
    """Booleans of tokens inside an opening and a closing token sequence; an open one masks to the end.

    One fold over the tokens that carries the state, the last tokens seen and the mask.
    """
    width = max(len(opening), len(closing))

    def ends_with(recent: Column, wanted: list[str]) -> Column:
        return F.slice(F.concat(F.array_repeat(F.lit(""), width), recent), -len(wanted), len(wanted)) == F.array(*(F.lit(w) for w in wanted))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("recent"), F.array().cast("array<boolean>").alias("mask"))

    def step(state: Column, token: Column) -> Column:
        recent = F.slice(F.concat(F.array_repeat(F.lit(""), width), state["recent"], F.array(token)), -width, width)
        opened = ~state["on"] & ends_with(recent, opening)
        closed = state["on"] & ends_with(recent, closing)
        on = (state["on"] | opened) & ~closed
        return F.struct(on.alias("on"), recent.alias("recent"), F.concat(state["mask"], F.array(state["on"] | opened)).alias("mask"))

    return F.aggregate(tokens, start, step)["mask"]
