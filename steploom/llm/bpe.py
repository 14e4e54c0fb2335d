"""Byte-level pair encoding of a text column.

Texts are cut into pieces by the vocabulary's pattern; a piece is encoded once a task and looked
up afterwards. Merging works on a segment tree over the ranks of adjacent pairs: a leaf holds
``rank * width + position`` of the pair that begins there, an inner node the minimum below it, so
the root names the leftmost pair of lowest rank. A merge rewrites three leaves (the pair, the one
before, the one after) and their paths, each of logarithmic length, until the root holds no pair.
Trees of equally wide pieces are updated together as rows of one array; a piece too wide for that
gets a tree of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)
WIDE = 64  # pieces of more bytes get a scalar tree
CACHE_PIECES = 400_000


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 stays, the rest moves up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


@dataclass
class Merges:
    """Merge rules: ``lookup`` finds the rank of adjacent ids, ``made`` the id a rank gives."""

    base: np.ndarray  # id of every byte
    made: np.ndarray  # id by rank
    slots: np.ndarray  # open addressing: key + 1, or 0
    ranks: np.ndarray
    bits: int

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Merges:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        bits = max(4, int(len(keys)).bit_length() + 2)
        slots, ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
        waiting, at = np.arange(len(keys)), cls._home(keys, bits)
        while len(waiting):
            free = slots[at] == 0
            slots[at[free]] = keys[waiting[free]] + np.uint64(1)  # of several on one slot the last stays
            stays = slots[at] == keys[waiting] + np.uint64(1)
            ranks[at[stays]] = waiting[stays]
            waiting, at = waiting[~stays], (at[~stays] + 1) & ((1 << bits) - 1)
        return cls(np.array([vocab[c] for c in byte_letters()], dtype=np.int32), made, slots, ranks, bits)

    @staticmethod
    def _home(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of ids, NONE where the pair doesn't merge or an id is negative."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.uint64) << np.uint64(16) | right[todo].astype(np.uint64)
        at = self._home(keys, self.bits)
        keys += np.uint64(1)
        while len(todo):
            held = self.slots[at]
            hit = held == keys
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (held != 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def rank(self, left: int, right: int) -> int:
        """Scalar form of :meth:`lookup`."""
        if left < 0 or right < 0:
            return int(NONE)
        key = (left << 16 | right) + 1
        at = (((key - 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while held := int(self.slots[at]):
            if held == key:
                return int(self.ranks[at])
            at = (at + 1) & ((1 << self.bits) - 1)
        return int(NONE)


def merge_rows(merges: Merges, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Encodes pieces of at most ``width`` bytes (a power of two); returns flat ids and counts."""
    n, cells = len(starts), width + 1
    column = np.arange(width)
    inside = column < lengths[:, None]
    ids = np.full((n, cells), -1, np.int32)
    ids[:, :width][inside] = merges.base[data[(starts[:, None] + column)[inside]]]
    alive = np.zeros((n, cells), bool)
    alive[:, :width] = inside
    after = np.minimum(np.arange(1, cells + 1), width).astype(np.int32) + np.zeros((n, 1), np.int32)
    after = np.where(after < lengths[:, None], after, width).astype(np.int32)
    before = np.arange(-1, cells - 1, dtype=np.int32) + np.zeros((n, 1), np.int32)
    tree = np.full((n, 2 * width), NONE, np.int32)
    pair = np.flatnonzero((column < lengths[:, None] - 1).ravel())
    row, pos = pair // width, pair % width
    rank = merges.lookup(ids[row, pos], ids[row, pos + 1])
    tree[row, width + pos] = np.where(rank == NONE, NONE, rank * width + pos)
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    flat_ids, flat_after, flat_before, flat_alive, flat_tree = (x.reshape(-1) for x in (ids, after, before, alive, tree))
    live = np.arange(n)
    while True:
        root = flat_tree[live * 2 * width + 1]
        on = root != NONE
        live, root = live[on], root[on]
        if not len(live):
            break
        pos, cell, base = root % width, live * cells, live * 2 * width
        gone = flat_after[cell + pos]
        beyond = flat_after[cell + gone]
        prior = flat_before[cell + pos]
        new = merges.made[root // width]
        flat_ids[cell + pos] = new
        flat_after[cell + pos] = beyond
        flat_before[cell + beyond] = pos
        flat_alive[cell + gone] = False
        left = np.where(prior >= 0, flat_ids[cell + np.maximum(prior, 0)], -1)
        ranks = merges.lookup(np.concatenate([new, left]), np.concatenate([flat_ids[cell + beyond], new]))
        here, back = ranks[: len(live)], ranks[len(live) :]
        first = prior < 0
        flat_tree[base + width + gone] = NONE
        flat_tree[base + width + pos] = np.where(here == NONE, NONE, here * width + pos)
        known = ~first
        flat_tree[(base + width + prior)[known]] = np.where(back == NONE, NONE, back * width + prior)[known]
        node = np.concatenate([width + gone, width + pos, (width + prior)[known]])
        base = np.concatenate([base, base, base[known]])
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            flat_tree[base + node] = np.minimum(flat_tree[base + 2 * node], flat_tree[base + 2 * node + 1])
    return ids[alive], alive.sum(1)


def merge_one(merges: Merges, piece: bytes) -> list[int]:
    """Encodes one piece of any length with a segment tree of its own."""
    ids = [int(merges.base[b]) for b in piece]
    n = len(ids)
    width = 1 << max(0, (n - 1).bit_length())
    none = int(NONE) << 32
    tree = [none] * (2 * width)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]

    def leaf(p: int) -> int:
        q = after[p]
        rank = merges.rank(ids[p], ids[q]) if q >= 0 else int(NONE)
        return none if rank == int(NONE) else rank << 32 | p

    for p in range(n):
        tree[width + p] = leaf(p)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    alive = [True] * n
    while (root := tree[1]) != none:
        p = root & 0xFFFFFFFF
        gone = after[p]
        ids[p] = int(merges.made[root >> 32])
        after[p] = after[gone]
        if after[p] >= 0:
            before[after[p]] = p
        alive[gone] = False
        changed = {gone: none, p: leaf(p)}
        if before[p] >= 0:
            changed[before[p]] = leaf(before[p])
        for q, value in changed.items():
            node = width + q
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
    return [x for x, a in zip(ids, alive, strict=True) if a]


def encode_pieces(merges: Merges, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the count of ids of every piece, in order."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths
    counts = np.zeros(len(pieces), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    width, low = 1, 0
    while width <= WIDE:
        chosen = np.flatnonzero((lengths > low) & (lengths <= width))
        for block in np.array_split(chosen, max(1, len(chosen) * width // (1 << 20))):
            if len(block):
                ids, counts[block] = merge_rows(merges, data, starts[block], lengths[block], width)
                parts.append((block, ids))
        low, width = width, 2 * width
    wide = np.flatnonzero(lengths > WIDE)
    for k in wide:
        ids = np.array(merge_one(merges, pieces[k]), np.int32)
        counts[k] = len(ids)
        parts.append((np.array([k]), ids))
    offsets = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for block, ids in parts:
        c = counts[block]
        out[np.repeat(offsets[block] - (np.cumsum(c) - c), c) + np.arange(len(ids))] = ids
    return out, counts


class _Codes(dict):
    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


class Encoder:
    """Encodes lists of texts, remembering the pieces it has seen (at most about CACHE_PIECES)."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges = merges
        self.cut = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of every piece, pieces of every text, ids of every text)."""
        if len(self.codes) > CACHE_PIECES:
            self._forget()
        pieces: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.cut(text)
                per_text[k] = len(found)
                pieces += found
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        fresh = [p.encode("utf-8", "surrogatepass") for p in islice(self.codes, len(self.counts), None)]
        if fresh:
            ids, counts = encode_pieces(self.merges, fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
        ends = np.cumsum(np.concatenate([[0], self.counts[codes]]))
        bounds = np.cumsum(np.concatenate([[0], per_text]))
        return codes, ends, ends[bounds]

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        codes, ends, bounds = self.encode(texts)
        counts = self.counts[codes]
        first = np.cumsum(self.counts) - self.counts
        take = np.repeat(first[codes] - ends[:-1], counts) + np.arange(int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.ids[take]))

    def sizes(self, texts: list[str | None]) -> pa.Array:
        bounds = self.encode(texts)[2]
        return pa.array(np.diff(bounds))


def _mapped(df: DataFrame, text: str, keep: list[str], out: str, kind: T.DataType, method: str, vocabulary: str) -> DataFrame:
    if out in keep:
        raise ValueError(f"{out} is kept and made")
    merges = Merges.read(vocabulary)  # half a megabyte, whatever the data
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges)
        for batch in batches:
            # bounds a block by its text, so that long texts don't add up
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(len(keep))), 0))
            block = np.cumsum(sizes) // (8 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                made = getattr(encoder, method)(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], schema=pa.schema([*list(batch.schema)[: len(keep)], pa.field(out, made.type)]))

    return rows.mapInArrow(run, schema)


def encode_text(df: DataFrame, text: str, keep: list[str], out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the ids of ``text`` without special tokens, as ``out``.

    Null and empty texts both give an empty list, never null. Strings that look like special
    tokens are ordinary text. Repeated rows are encoded alike and all kept; rows stay in their
    partitions, there is no shuffle. Columns outside ``keep`` are not read.
    """
    return _mapped(df, text, keep, out, T.ArrayType(T.IntegerType()), "lists", vocabulary)


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the number of ids of ``text``; 0 for null and empty texts."""
    return _mapped(df, text, keep, out, T.LongType(), "sizes", vocabulary)
