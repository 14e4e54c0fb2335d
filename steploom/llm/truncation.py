"""Texts that were cut by a field limit or a broken transfer.

Two kinds of evidence are combined by Bayes' rule. Lengths: per source a log-normal is fitted by
maximum likelihood to the length histogram, values at candidate limits counting as right-censored;
what a limit holds beyond the fitted density is the censoring posterior of a value of that length.
Limits are looked for in code points and in UTF-8 bytes, markers that an exporter puts behind a cut
aside. The posterior's odds are multiplied with the odds of the
ending; away from limits, the ending stands alone. Endings: an open tag, a cut marker and a broken
character speak for a cut, a finished sentence or closing tag against it. An open quote or bracket speaks
for a cut as far as the source's finished sentences have none.

Words without an end are weighed by what the corpus does with them: of all sentences and lines
that begin like the tail, the share that end where it ends. A note that always stops there is
complete, the first half of a sentence seen elsewhere is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.endings import ABBREVIATIONS, TAGS, TAIL, count_of, open_quote, tail_of, unclosed
from steploom.plans.storage import store

CUT, CLOSED, OPEN, NOTHING = "cut", "closed", "open", "nothing"
BINS = 40  # of the odds of open endings, for the histogram
STRONG = 500.0  # odds of a cut by a marker, a broken character or an open tag; those of open endings are held to these
# A text that stops right behind a sentence isn't cut within it, however likely a limit met it there.
FINISHED = 1 / 2000
UNPAIRED = 0.05  # share of cut texts that leave a quote, or a bracket, open
RARE, WEIGHT = 0.001, 20.0  # the same for complete texts, before WEIGHT rows have said otherwise
KINDS = ("marker", "broken", "tag", "quote", "quote.", "bracket", "bracket.", CLOSED, *(f"{OPEN}{k}" for k in range(BINS)))
NEAR = 3  # a limit in bytes can cut a character of up to four, and white space at a cut may be lost
# Marks that exporters put where they cut.
MARKER = r"(?i)(?:\.\.\.|…|\[\s*(?:\.\.\.|…|cut|truncated|snip|more)\s*\])\s*$"
SHORT = 15  # tails up to this length are looked up by exact prefix
HEADS = (16, 32, 64, 128, 256)  # longer ones are joined on the longest of these heads they fill


def ending(text: Column) -> Column:
    """Kind of ending: one of KINDS, those with a full stop behind a finished sentence; OPEN or NOTHING (null, or no letter or digit)."""
    tail = tail_of(text)
    brackets = (count_of(text, "(") > count_of(text, ")")) | (count_of(text, "[") > count_of(text, "]"))
    finished = tail.rlike(r"[.!?。！？]['\"”’»)\]]*$|[)\]}]$|</[A-Za-z]+>$") & ~F.lower(tail).rlike(r"(?:^|[\s(])" + ABBREVIATIONS + r"\.$")
    kind = F.when(text.isNull() | ~text.rlike(r"[\p{L}\p{N}]"), NOTHING).when(text.endswith("�"), "broken").when(tail.rlike(MARKER), "marker")
    kind = kind.when(unclosed(text), "tag").when(open_quote(text) & finished, "quote.").when(open_quote(text), "quote")
    return kind.when(brackets & finished, "bracket.").when(brackets, "bracket").when(finished, CLOSED).otherwise(OPEN)


def before_cut(text: Column) -> Column:
    """The text without a marker or a broken character that a cut left at its end."""
    return F.when(F.right(text, F.lit(TAIL)).rlike(MARKER + "|�$"), F.regexp_replace(text, r"\s*" + MARKER + "|�+$", "")).otherwise(text)


def _pieces(text: Column) -> Column:
    """Sentences and lines; what stands between tags are lines."""
    text = F.when(text.contains("<") | text.contains("["), F.regexp_replace(text, "<[/]?(?:" + "|".join(TAGS) + r")>|\[/?(?:" + "|".join(TAGS) + r")\]", "\n")).otherwise(text)
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def template(piece: Column) -> Column:
    """A sentence with its names and numbers replaced, as sentences of one kind differ in these."""
    named = F.regexp_replace(F.trim(piece), r"(?U)\b\p{Lu}[\w'’-]*(?:\s+(?:of\s+)?\p{Lu}[\w'’-]*)+", "N")
    named = F.regexp_replace(named, r"(?U)(?<=\s)\p{Lu}[\w'’-]+", "N")
    return F.regexp_replace(F.regexp_replace(named, r"N(?: N)+", "N"), r"\p{N}[\p{N},.]*", "9")


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum-likelihood (mu, sigma) of log length by EM; values at ``limits`` are at least that long."""
    x = np.log(lengths)
    censored = np.isin(lengths, limits)
    mu, sigma = float(np.average(x, weights=counts)), max(0.05, float(np.sqrt(np.cov(x, fweights=counts))) if counts.sum() > 1 else 0.5)
    for _ in range(rounds):
        z = (x - mu) / sigma
        tail = np.maximum(_upper(z), 1e-12)
        hazard = np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi) / tail
        first = np.where(censored, mu + sigma * hazard, x)
        second = np.where(censored, mu * mu + sigma * sigma + sigma * (x + mu) * hazard, x * x)
        new_mu = float(np.average(first, weights=counts))
        new_sigma = float(np.sqrt(max(np.average(second, weights=counts) - new_mu * new_mu, 1e-4)))
        if abs(new_mu - mu) + abs(new_sigma - sigma) < 1e-7:
            break
        mu, sigma = new_mu, new_sigma
    return mu, sigma


def _upper(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal (error below 2e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    p = np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


def _atoms(lengths: np.ndarray, counts: np.ndarray, unfinished: np.ndarray) -> tuple[np.ndarray, ...]:
    """(length, count, surroundings) of lengths that stand out and mostly hold unfinished texts."""
    length, place = np.unique(lengths, return_inverse=True)
    n, cut = np.bincount(place, counts), np.bincount(place, unfinished)
    total = np.concatenate([[0], np.cumsum(n)])
    low, high = np.searchsorted(length, length - 12), np.searchsorted(length, length + 12, side="right")
    near = (total[high] - total[low] - n) / 24
    stands = (n >= 5) & (n > 3 * near + 3 * np.sqrt(near + 1)) & (cut >= 0.5 * n)
    return length[stands], n[stands], near[stands]


def find_limits(chars: np.ndarray, octets: np.ndarray, counts: np.ndarray, unfinished: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(unit, limit, length, censoring posterior) from a histogram of lengths in code points and bytes.

    A length belongs to the limit it is at or, by less than a character, below.

    ``unfinished`` is the expected number of unfinished texts by their endings. The limit that
    stands out most is taken first and its texts set aside, so that a limit in bytes isn't found
    again in code points. The posterior is what the censored fit doesn't expect at that length.
    """
    left = np.ones(len(counts), bool)
    found: list[tuple[str, int, float]] = []
    while True:
        best = (0.0, "", 0, 0.0)
        for unit, lengths in (("chars", chars), ("bytes", octets)):
            for length, n, near in zip(*_atoms(lengths[left], counts[left], unfinished[left]), strict=True):
                best = max(best, (float(n - near), unit, int(length), float(n)))
        if not best[0]:
            break
        found.append(best[1:])
        left &= (chars if best[1] == "chars" else octets) != best[2]
    # neighbours are one limit: the longest, of which the others fall short by part of a character or white space
    out = []
    for unit, lengths in (("chars", chars), ("bytes", octets)):
        limits = sorted(x for u, x, _ in found if u == unit)
        mu, sigma = fit_censored(lengths, counts, np.array(limits))
        while limits:
            top = limits.pop()
            while limits and limits[-1] >= top - NEAR:
                limits.pop()
            at = np.arange(top - NEAR, top + 1)
            held = np.array([counts[lengths == x].sum() for x in at])
            z = (np.log(np.maximum(at, 1)) - mu) / sigma
            expected = counts.sum() * np.exp(-0.5 * z * z) / (np.sqrt(2 * np.pi) * sigma * np.maximum(at, 1))
            posterior = np.clip(1 - expected / np.maximum(held, 1e-9), 0.001, 0.999)
            for x, n, p in zip(at.tolist(), held.tolist(), posterior.tolist(), strict=True):
                if n and (p > 0.5 or x == top):
                    out.append((unit, int(top), int(x), p))
    return sorted(out)


def bin_of(complete: Column) -> Column:
    """Kind of an open ending: the place of its log odds between those of STRONG."""
    odds = F.log((1 - complete + 1e-9) / (complete + 1e-9)) / (2 * np.log(STRONG)) + 0.5
    return F.concat(F.lit(OPEN), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(odds * BINS))))


def odds_of(counts: dict[str, float]) -> dict[str, float]:
    """Odds of a cut by each kind of ending in a source with these numbers of texts."""
    odds = {"marker": STRONG, "broken": STRONG, "tag": STRONG, CLOSED: FINISHED}
    finished = sum(counts.get(k, 0.0) for k in ("quote.", "bracket.", CLOSED))
    for kind in ("quote", "bracket"):
        share = (counts.get(f"{kind}.", 0.0) + WEIGHT * RARE) / (finished + WEIGHT)
        odds[kind] = min(STRONG, UNPAIRED / share)
        odds[f"{kind}."] = odds[kind] / 3
    for k in range(BINS):
        odds[f"{OPEN}{k}"] = float(STRONG ** (2 * (k + 0.5) / BINS - 1))
    return odds


def combine(posterior: float | None, odds: float) -> float:
    """Probability of a cut by the censoring posterior at a limit (None elsewhere) and the odds of the ending."""
    odds *= posterior / (1 - posterior) if posterior is not None else 1.0
    return odds / (1 + odds)


class Truncation:
    """Cut texts of one table (``record``, ``source``, ``text``).

    Null texts and texts without a letter or digit are no cases. Repeated rows count each. A null
    source is a source of its own. Columns besides the three are not read. Everything is counted
    over all rows, and no step gathers the texts of a source in one task: only histograms (a row
    per source and length) and distinct templates are grouped. Features of the rows, without
    their texts, are stored once.
    """

    def __init__(self, df: DataFrame, record: str, source: str, text: str):
        self.texts = df.select(F.col(f"`{record}`").alias("record"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
        self._weighed: DataFrame | None = None
        self._judged: DataFrame | None = None

    def weighed(self) -> DataFrame:
        """(record, source, kind, chars, bytes, complete) of all rows; ``complete`` for open endings."""
        if self._weighed is None:
            text = F.col("text")
            rows = self.texts.withColumn("kind", ending(text)).withColumn("kept", before_cut(text))
            tail = F.when(F.col("kind") == OPEN, template(F.try_element_at(_pieces(text), F.lit(-1))))
            rows = store(rows.select("record", "source", F.length("kept").alias("chars"), F.octet_length("kept").alias("bytes"), "kind", tail.alias("tail")), "endings")
            style = F.sum((F.col("kind") == OPEN).cast("double")) / F.sum(F.col("kind").isin(OPEN, CLOSED).cast("double"))
            habit = rows.where(F.col("kind").isin(OPEN, CLOSED)).groupBy(F.col("source").alias("s")).agg(style.alias("habit"))
            opened = rows.where(F.col("kind") == OPEN)
            opened = opened.join(self.continuations(opened), "tail").join(habit, F.col("source").eqNullSafe(F.col("s")))
            # without the row itself; of a tail that no other text has, the source's habit decides
            complete = (F.col("ends") - 1 + F.col("habit")) / F.greatest(F.lit(1), F.greatest("ends", "begins"))
            opened = opened.select("record", "source", "chars", "bytes", bin_of(complete).alias("kind"), complete.alias("complete"))
            others = rows.where(F.col("kind") != OPEN).drop("tail").withColumn("complete", F.lit(None).cast("double"))
            self._weighed = store(opened.unionByName(others), "weighed")
        return self._weighed

    def judged(self) -> DataFrame:
        """(source, unit, limit, length, kind, posterior, p_cut): what a value of a length and ending is, once for each source.

        ``unit`` is null for lengths without a limit. The rows are few: kinds of ending times limits.
        """
        if self._judged is None:
            spoken = F.when(F.col("complete").isNotNull(), 1 - F.col("complete")).otherwise((F.col("kind") != CLOSED).cast("double"))
            histogram = self.weighed().where(F.col("kind") != NOTHING).groupBy("source", "chars", "bytes", "kind").agg(F.count("*").alias("n"), F.sum(spoken).alias("unfinished"))
            columns = ["source", "unit", "limit", "length", "kind", "posterior", "p_cut"]

            def fit(pdf: pd.DataFrame) -> pd.DataFrame:
                chars, octets, n, unfinished = (pdf[c].to_numpy(dtype=float) for c in ("chars", "bytes", "n", "unfinished"))
                found = find_limits(chars, octets, n, unfinished)
                odds = odds_of(pdf.groupby("kind")["n"].sum().to_dict())
                source = pdf["source"].iloc[0]
                out = [(source, u, limit, length, k, p, combine(p, odds[k])) for u, limit, length, p in [(None, None, None, None), *found] for k in KINDS]
                return pd.DataFrame(out, columns=columns)

            self._judged = store(histogram.groupBy("source").applyInPandas(fit, "source string, unit string, limit int, length int, kind string, posterior double, p_cut double"), "judged")
        return self._judged

    def limits(self) -> DataFrame:
        """(source, unit, length, posterior): the limits found, a handful a source."""
        found = self.judged().where("unit is not null").select("source", "unit", F.col("limit").alias("length"), F.struct(F.col("length").alias("at"), "posterior").alias("p"))
        return found.groupBy("source", "unit", "length").agg(F.max("p")["posterior"].alias("posterior"))

    def continuations(self, opened: DataFrame) -> DataFrame:
        """(tail, ends, begins): texts that end in a tail, and pieces of texts that begin like it."""
        pieces = self.texts.select(F.explode(_pieces(F.col("text"))).alias("piece"))
        counted = store(pieces.groupBy(template(F.col("piece")).alias("piece")).count(), "templates")
        tails = opened.groupBy("tail").agg(F.count("*").alias("ends"))
        short = tails.where(F.length("tail") <= SHORT)
        upto = F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("piece")))
        prefixes = counted.where(F.length("piece") > 0).select(F.explode(upto).alias("k"), "piece", "count").groupBy(F.expr("left(piece, k)").alias("tail")).agg(F.sum("count").alias("begins"))
        near = short.join(prefixes, "tail", "left")
        sizes = F.array(*(F.lit(h) for h in HEADS))
        long = tails.where(F.length("tail") > SHORT).withColumn("k", F.array_max(F.filter(sizes, lambda h: h <= F.length("tail")))).withColumn("head", F.expr("left(tail, k)"))
        heads = counted.select("piece", "count", F.explode(F.filter(sizes, lambda h: h <= F.length("piece"))).alias("k")).withColumn("head", F.expr("left(piece, k)"))
        far = long.join(heads, ["head", "k"], "left").groupBy("tail").agg(F.max("ends").alias("ends"), F.sum(F.when(F.startswith("piece", "tail"), F.col("count"))).alias("begins"))
        both = near.select("tail", "ends", "begins").unionByName(far)
        return both.select("tail", "ends", F.coalesce("begins", F.lit(0)).alias("begins"))

    def scored(self) -> DataFrame:
        """(record, source, kind, limit, p_cut) of every text with words; limit and p_cut are those of the stronger unit."""
        rows = self.weighed().where(F.col("kind") != NOTHING)
        for unit in ("chars", "bytes", None):
            # a row a source, limit and kind: far below the rows it is joined to
            found = self.judged().where(F.col("unit").eqNullSafe(unit)).select(F.col("source").alias("s"), F.col("length").alias("at"), F.col("kind").alias("k"), F.struct(F.col("posterior").alias("w"), "limit", "p_cut").alias(f"by_{unit}"))
            met = rows["source"].eqNullSafe(found["s"]) & (rows["kind"] == found["k"])
            rows = rows.join(found, met & (rows[unit] == found["at"]) if unit else met, "left").drop("s", "at", "k")
        best = F.coalesce(F.greatest("by_chars", "by_bytes"), "by_None")
        return rows.select("record", "source", "kind", best["limit"].alias("limit"), best["p_cut"].alias("p_cut"))

    def cut(self) -> DataFrame:
        """(record, source, limit, p_cut) of the cut texts; limit is null for broken transfers."""
        return self.scored().where("p_cut > 0.5").drop("kind")

    def by_source(self) -> DataFrame:
        """(source, n, n_cut, share) over all rows of each source, empty texts included."""
        cut = self.cut().groupBy(F.col("source").alias("s")).agg(F.count("*").alias("c"))
        total = self.texts.groupBy("source").agg(F.count("*").alias("n"))
        n_cut = F.coalesce("c", F.lit(0)).cast("long")
        return total.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", n_cut.alias("n_cut"), F.round(n_cut / F.col("n"), 6).alias("share"))
