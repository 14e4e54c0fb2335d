"""Recompression of texts: names for runs and pairs of symbols, and the chains of symbols they form.

A text starts as one symbol per code point. A first round names runs of equal symbols; the rounds
after it name pairs: every symbol is put left or right by a bit of its name, and each left symbol
followed by a right one becomes one symbol. A name is the hash of its production (symbol and count,
or left and right symbol), so it is the same in every task and round without a dictionary to be
shuffled, and equal substrings get equal symbols except near their ends.

Only symbols of at most the round's ``reach`` code points take part in it. Whether a boundary between
symbols survives a round then depends on no more text than the sum of the reaches on either side, and
no symbol exceeds twice the last reach. Runs longer than RUN stay single code points, so that the
boundaries in them don't depend on where a run began.

``MIDDLE`` rounds give short symbols (at most 4 code points) that are the same from EDGE code points
inside an equal stretch on; chains of these are what is named and compared. The further rounds say
which of their boundaries are high: from CONTEXT code points inside an equal stretch on, the level of
a boundary is the same as well.
"""

from __future__ import annotations

import numpy as np

RUN = 2
# reaches of the pair rounds
MIDDLE = (1, 2, 2)
UPPER = (3, 4, 7, 9)
EDGE = RUN + sum(MIDDLE)
CONTEXT = EDGE + sum(UPPER)
TOP = 1 + len(MIDDLE) + len(UPPER) + 1

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))


class Sequence:
    """Names of any stretch of a sequence of symbols, by prefix sums."""

    def __init__(self, symbols: np.ndarray, powers: Powers):
        powers.reach(len(symbols))
        self.powers = powers
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(77)) * powers.up[: len(symbols)], out=self.sums[1:])

    def names(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """64-bit names of the symbols from ``low`` up to before ``high``."""
        return mix((self.sums[high] - self.sums[low]) * self.powers.down[low])


class Texts:
    """Code points of several texts, a separator behind each."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.ends = self.starts + self.lengths


class Symbols:
    """The symbols of ``texts`` after all rounds.

    ``middle`` and ``names`` are starts and names of the symbols after the MIDDLE rounds, separators
    included. ``level`` has for every code point the round in which the boundary before it goes, TOP
    for those that stay; ``high`` and ``ties`` are starts that stay and the name of the two symbols
    that meet there.
    """

    def __init__(self, texts: Texts, powers: Powers):
        points, n = texts.points, len(texts.points)
        self.level = np.full(n, TOP, np.uint8)
        name = _mix32(points * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B))
        single = np.zeros(n, bool)  # symbols that take part in no round: separators, and code points of long runs
        single[texts.ends] = True
        start, name, single = self._runs(name, single)
        for k, reach in enumerate((*MIDDLE, *UPPER), 2):
            start, name, single = self._pairs(start, name, single, k, reach)
            if k == 1 + len(MIDDLE):
                self.middle, self.names = start, name
        self.high = start[1:]
        self.ties = mix(name[:-1].astype(np.uint64) << np.uint64(32) | name[1:])
        self.chains = Sequence(self.names, powers)

    def _runs(self, name: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(name)
        begins = np.ones(n, bool)
        begins[1:] = (name[1:] != name[:-1]) | single[1:] | single[:-1]
        first = np.flatnonzero(begins)
        count = np.diff(np.append(first, n))
        whole = np.repeat(count > RUN, count)
        keep = begins | whole
        self.level[~keep] = 1
        single |= whole
        pairs = first[(count > 1) & (count <= RUN)]
        name[pairs] = _mix32(name[pairs] * np.uint32(0x01000193) ^ count[(count > 1) & (count <= RUN)].astype(np.uint32))
        start = np.flatnonzero(keep).astype(np.int32)
        return start, name[start], single[start]

    def _pairs(self, start: np.ndarray, name: np.ndarray, single: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, ...]:
        size = np.empty(len(start), np.int32)
        np.subtract(start[1:], start[:-1], out=size[:-1])
        size[-1] = len(self.level) - start[-1]
        small = (size <= reach) & ~single
        left = ((name * np.uint32(0x2C1B3C6D + 2 * k)) >> np.uint32(31)).astype(bool)
        gone = np.flatnonzero((left & small)[:-1] & (small & ~left)[1:]) + 1
        self.level[start[gone]] = k
        keep = np.ones(len(start), bool)
        keep[gone] = False
        name[gone - 1] = _mix32(name[gone - 1] * np.uint32(0x85EBCA77) + name[gone] + np.uint32(k))
        return start[keep], name[keep], single[keep]

    def chain(self, at: np.ndarray, left: int, right: int) -> np.ndarray:
        """Names of the whole symbols from ``left`` before to ``right`` behind the boundaries ``at``.

        The number of symbols before ``at`` is part of the name, so that equal names are aligned.
        """
        low, here = np.searchsorted(self.middle, at - left), np.searchsorted(self.middle, at)
        high = np.searchsorted(self.middle, at + right, side="right") - 1
        return mix(self.chains.names(low, high) + (here - low).astype(np.uint64))


def _slide(values: np.ndarray, width: int, best, backwards: bool) -> np.ndarray:
    """``best`` over the ``width`` values from each place on (or up to it), by doubling."""
    out = values[::-1].copy() if backwards else values.copy()
    done = 1
    while done < width:
        step = min(done, width - done)
        best(out[:-step], out[step:], out=out[:-step]) if step < len(out) else None
        done += step
    return out[::-1] if backwards else out


def anchors(texts: Texts, symbols: Symbols, span: int) -> np.ndarray:
    """Boundaries of symbols of which every stretch of ``span`` code points contains one.

    Of the boundaries that lie at least CONTEXT from both ends of a stretch, the one of the highest
    level is its anchor (ties: by the name of the symbols that meet there, then all of them). Its
    choice depends on the stretch alone, so two texts that share the stretch share the anchor.
    """
    n = len(texts.points)
    key = (np.uint64(TOP) - symbols.level.astype(np.uint64)) << np.uint64(56)
    key[symbols.high] = symbols.ties >> np.uint64(8) | np.uint64(1)  # never 0, which marks "no stretch"
    lowest = _slide(key, span - 2 * CONTEXT + 1, np.minimum, False)
    usable = np.zeros(n, bool)
    # first boundaries of the stretches, text by text
    counts = np.maximum(texts.lengths - span + 1, 0)
    first = np.repeat(texts.starts + CONTEXT - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    usable[first] = True
    lowest[~usable] = 0
    reached = _slide(lowest, span - 2 * CONTEXT + 1, np.maximum, True)
    return np.flatnonzero((key == reached) & (reached > 0))
