"""Spans of at least ``span`` code points that stand word for word in more than one text.

1. Every distinct text is recompressed (:mod:`steploom.llm.recompress`). Each stretch of ``span``
   code points has an anchor, a boundary of the highest level inside it, and the chain of symbols
   to both sides of the anchor is the same wherever the stretch occurs.
2. A Spark round names the chains of all anchors globally and drops those that one text alone has.
   Tasks compare within their own rows first, so a name that fills a third of the rows reaches its
   bucket once a task; the rest goes straight on.
3. A second Spark round names the survivors' wider chains, one for each of the PARTS in which a
   stretch may lie around its anchor, three quarters of the stretch long. Again only names that
   several texts have go on.
4. Within a class of equal names the texts are compared code point by code point, and only matches
   of ``span`` or more count. A class too large for pairwise comparison is split by the names of
   its full stretches instead, and joined on these.

A match is reported at its first anchor (or, in large classes, its first stretch), so long matches
don't multiply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.recompress import CONTEXT, EDGE, Powers, Sequence, Symbols, Texts, anchors, mix
from steploom.plans.storage import store

SPAN = 100
CHUNK_POINTS = 1 << 20
BLOCK_ROWS = 1 << 20
BUCKET_POINTS = 1 << 24  # code points of text a bucket of names, some 12 MB of rows
FILTER_BITS = 1 << 23  # of the filter in front of the join of anchors and texts: at most 131,072 rows
NAME_BYTES = 6  # of a name are sent to its bucket; names that agree in these only add candidates
PARTS = 4  # places that are told apart in which a stretch may lie around its anchor
PAIRWISE = 64  # classes up to this size are compared pair by pair, larger ones by their stretches
EXPAND = 64  # classes of exact copies up to this size are written out pair by pair
CROWD = 64  # texts with one stretch in common up to which all their pairs are written out

DECIDE, PASS, EVIDENCE = 0, 1, 2


def _blocks(names: np.ndarray, keys: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One block a bucket of (name, key, position, kind), after comparison within these rows."""
    order = np.argsort(names, kind="stable")
    names, keys, at = names[order], keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    size = np.diff(np.append(first, len(names)))
    sure = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
    kind = np.where(np.repeat(sure, size), PASS, DECIDE).astype(np.int8)
    lead = first[sure]
    names, keys, at = (np.concatenate([x, x[lead]]) for x in (names, keys, at))
    kind = np.concatenate([kind, np.full(len(lead), EVIDENCE, np.int8)])
    spread = np.where(kind == PASS, keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64), names)
    bucket = (spread % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    marks = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
    ids, data = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = order[a:b]
        ids.append(int(marks[a]))
        short = names[part].view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
        data.append(b"".join((short.tobytes(), *(x[part].tobytes() for x in (keys, at.astype(np.int32), kind)))))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["bucket", "block"])


def _unblock(data: bytes) -> tuple[np.ndarray, ...]:
    n = len(data) // (NAME_BYTES + 13)
    names = np.zeros((n, 8), np.uint8)
    names[:, :NAME_BYTES] = np.frombuffer(data, np.uint8, NAME_BYTES * n).reshape(n, NAME_BYTES)
    rest = [np.frombuffer(data, t, n, (NAME_BYTES + at) * n) for t, at in ((np.int64, 0), (np.int32, 8), (np.int8, 12))]
    return names.view(np.uint64).ravel(), *rest


def places(span: int) -> list[tuple[int, int]]:
    """(least, most) code points of a stretch before its anchor, for each of PARTS parts."""
    cuts = [CONTEXT + (span - 2 * CONTEXT + 1) * k // PARTS for k in range(PARTS + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def shared_symbols(texts: DataFrame, span: int, buckets: int) -> DataFrame:
    """(key, at) of the anchors of ``texts`` (key, text) whose chain more than one key has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = points = 0
        some: list[str] = []
        keys: list[int] = []

        def symbols() -> int:
            block = Texts(some)
            parsed = Symbols(block, powers)
            p = anchors(block, parsed, span)
            text = np.searchsorted(block.starts, p, side="right") - 1
            held.append((parsed.chain(p, CONTEXT - EDGE, CONTEXT - EDGE), np.array(keys, np.int64)[text], p - block.starts[text]))
            some.clear()
            keys.clear()
            return len(p)

        def flush() -> pa.RecordBatch:
            out = _blocks(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:  # an exact copy
                    continue
                if len(seen) < 1 << 20:
                    seen.add(key)
                some.append(text)
                keys.append(key)
                points += len(text)
                if points >= CHUNK_POINTS:
                    rows += symbols()
                    points = 0
                    if rows >= BLOCK_ROWS:
                        yield flush()
                        rows = 0
        if some:
            rows += symbols()
        if rows:
            yield flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for block in batch.column(1):
                name, key, at, kind = _unblock(block.as_buffer())
                on = kind == PASS
                if on.any():
                    yield _symbols(key[on], at[on])
                parts.append(tuple(x[~on] for x in (name, key, at, kind)))
        if not any(len(p[0]) for p in parts):
            return
        name, key, at, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(name, kind="stable")
        name, key, at, kind = name[order], key[order], at[order], kind[order]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        shared = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | (np.maximum.reduceat(kind, first) == EVIDENCE)
        on = np.repeat(shared, np.diff(np.append(first, len(name)))) & (kind == DECIDE)
        if on.any():
            yield _symbols(key[on], at[on])

    def _symbols(key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at)], ["key", "at"])

    blocks = texts.mapInArrow(find, "bucket int, block binary").repartitionById(buckets, "bucket")
    return blocks.mapInArrow(decide, "key long, at int")


def _contexts(found: DataFrame, span: int) -> DataFrame:
    """(key, at, left, around, names): each anchor with the text a stretch around it may take.

    ``left`` is the anchor's place in ``around``; ``names`` has the name of the wider chain for each
    part, null where the text leaves no room for a stretch.
    """
    reach = span - CONTEXT + 1
    parts = places(span)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[tuple] = []
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for at in found:
                    begin = max(0, at - reach)
                    out.append((key, at, at - begin, text[begin : at + reach]))
                if len(out) > 20_000:
                    yield _rows(out, powers)
                    out = []
            if out:
                yield _rows(out, powers)

    def _rows(out: list[tuple], powers: Powers) -> pa.RecordBatch:
        key, at, left, around = zip(*out, strict=True)
        block = Texts(list(around))
        parsed = Symbols(block, powers)
        place = np.array(left, np.int64)
        p = block.starts + place
        names = np.empty((len(out), len(parts)), np.uint64)
        room = np.empty((len(out), len(parts)), bool)
        for k, (least, most) in enumerate(parts):
            room[:, k] = (place >= least) & (block.lengths - place >= span - most)
            on = room[:, k]
            names[on, k] = mix(parsed.chain(p[on], least - EDGE, span - most - EDGE) + np.uint64(k))
        flat = pa.array(names.view(np.int64).ravel(), mask=~room.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(parts)), flat)
        arrays = [pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(left, pa.int32()), pa.array(around, pa.string()), lists]
        return pa.RecordBatch.from_arrays(arrays, ["key", "at", "left", "around", "names"])

    return found.mapInArrow(cut, "key long, at int, left int, around string, names array<long>")


def _matrix(left: np.ndarray, around: list[str], reach: int) -> np.ndarray:
    """The contexts as rows of code points, anchors aligned; beyond a text's ends -1."""
    lengths = np.fromiter(map(len, around), np.int64, len(around))
    points = np.frombuffer("".join(around).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.full((len(around), 2 * reach), -1, np.int32)
    row = np.repeat(np.arange(len(around)), lengths)
    column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(reach - left.astype(np.int64), lengths)
    out[row, column] = points
    return out


def _triangle(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within consecutive groups of these (bounded) sizes."""
    a, b = [], []
    begin = np.cumsum(sizes) - sizes
    for m in np.unique(sizes):
        i, j = np.triu_indices(int(m), 1)
        at = begin[sizes == m][:, None]
        a.append((at + i).ravel())
        b.append((at + j).ravel())
    return np.concatenate(a), np.concatenate(b)


def _compared(contexts: DataFrame, span: int, intervals: bool) -> DataFrame:
    """Matches in small classes: pairs of keys, or the matched interval of each key."""
    reach = span - CONTEXT + 1
    parts = np.array(places(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 30_000:
                table = pa.Table.from_batches(held)
                names = np.asarray(table["name"])
                last = int(np.searchsorted(names, names[-1]))  # the last class may go on
                if last:
                    yield from match(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = table.num_rows - last
        if size:
            yield from match(pa.Table.from_batches(held))

    def match(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, keys, at, part = (np.asarray(table[c]) for c in ("name", "key", "at", "part"))
        grid = _matrix(np.asarray(table["left"]), table["around"].to_pylist(), reach)
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        i, j = _triangle(np.diff(np.append(first, len(names))))
        on = keys[i] != keys[j]
        i, j = i[on], j[on]
        low = at.astype(np.int64) + span
        high = np.full(len(keys), -1, np.int64)
        for k in range(0, len(i), 50_000):
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            least, most = parts[part[x]].T
            same = (grid[x] == grid[y]) & (grid[x] >= 0)
            back = np.cumprod(same[:, reach - 1 :: -1], axis=1, dtype=np.int8).sum(1)
            ahead = np.cumprod(same[:, reach:], axis=1, dtype=np.int8).sum(1)
            good = np.maximum(least, span - ahead) <= np.minimum(most, back)  # names are hashes; the text decides
            if intervals:
                x, y, back, ahead = x[good], y[good], np.minimum(back, most)[good], np.minimum(ahead, span - least)[good]
                for z in (x, y):
                    np.minimum.at(low, z, at[z] - back)
                    np.maximum.at(high, z, at[z] + ahead)
            else:
                good &= back <= most  # else an earlier anchor, or another part, reports the match
                x, y = x[good], y[good]
                if len(x):
                    pair = np.unique(np.stack([np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])
        if intervals and (on := high >= 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(low[on]), pa.array(high[on])], ["key", "low", "high"])

    rows = contexts.repartition("name").sortWithinPartitions("name")
    return rows.mapInArrow(run, "key long, low long, high long" if intervals else "a long, b long")


def _stretches(contexts: DataFrame, span: int) -> DataFrame:
    """(stretch, key, begin, before): every full stretch around the anchors of large classes."""
    parts = np.array(places(span))
    width = int((parts[:, 1] - parts[:, 0]).max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                key, at, left, which = (np.asarray(part.column(part.schema.get_field_index(c))).astype(np.int64) for c in ("key", "at", "left", "part"))
                block = Texts(part.column(part.schema.get_field_index("around")).to_pylist())
                every = Sequence(block.points, powers)
                least, most = parts[which].T
                before = least[:, None] + np.arange(width)
                begin = left[:, None] - before
                ok = (before <= most[:, None]) & (begin >= 0) & (begin + span <= block.lengths[:, None])
                row = np.nonzero(ok)[0]
                begin = begin[ok]
                place = block.starts[row] + begin
                doc_begin = at[row] - (left[row] - begin)
                ahead_of = np.where(doc_begin > 0, block.points[np.maximum(place - 1, 0)].astype(np.int64), -1)
                arrays = [pa.array(every.names(place, place + span).view(np.int64)), pa.array(key[row]), pa.array(doc_begin), pa.array(ahead_of)]
                yield pa.RecordBatch.from_arrays(arrays, ["stretch", "key", "begin", "before"])

    return contexts.mapInArrow(run, "stretch long, key long, begin long, before long")


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose key may be among ``keys``; spares the shuffle of most other texts.

    FILTER_BITS bits are broadcast, as words of 64, however many keys there are.
    """
    word, bit = F.expr(f"pmod(key, {FILTER_BITS}L) div 64"), F.expr("shiftleft(1L, cast(pmod(key, 64L) as int))")
    words = keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    return rows.join(F.broadcast(words), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


class SharedSpans:
    """Shared spans of the texts of one table; parts are computed when asked for."""

    def __init__(self, df: DataFrame, doc: str, text: str, span: int = SPAN, buckets: int | None = None):
        """``doc`` names a record (rows with a null id or text are left out; they share nothing).

        ``span`` must be at least 2 * CONTEXT + PARTS. Lengths are counted in Unicode code points, and
        equality is exact: no folding of case, width or white space.
        """
        if span < 2 * CONTEXT + PARTS:
            raise ValueError(f"a span of at least {2 * CONTEXT + PARTS} code points is needed")
        self.span = span
        rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
        self.rows = rows.where(F.col("doc").isNotNull() & (F.length("text") >= span)).withColumn("key", F.xxhash64("text"))
        self._buckets = buckets
        members = self.rows.select("key", "doc").distinct()
        self.members = members
        self.classes = members.groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
        self._parts: tuple[DataFrame, DataFrame] | None = None

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """Contexts of the small and of the large classes, once for each part whose name is shared."""
        if self._parts is None:
            if self._buckets is None:
                points = self.rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
                self._buckets = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(points / BUCKET_POINTS))
            symbols = shared_symbols(self.rows.select("key", "text"), self.span, self._buckets)
            by_text = store(symbols.groupBy("key").agg(F.collect_list("at").alias("found")), "anchors", release=True)
            wanted = by_text.join(self.classes.select("key", F.col("rep").alias("doc")), "key")
            found = wanted.join(_maybe(self.rows, by_text), ["key", "doc"]).select("key", "text", "found")
            contexts = store(_contexts(found, self.span), "contexts", release=True)
            named = contexts.select("key", "at", F.posexplode("names").alias("part", "name")).where("name is not null")
            sizes = named.groupBy("name").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            shared = store(named.join(sizes.where("lo <> hi").select("name", "n"), "name"), "shared-names")
            rows = contexts.drop("names").join(shared, ["key", "at"]).select("name", "key", "at", "part", "left", "around", "n")
            self._parts = rows.where(F.col("n") <= PAIRWISE).drop("n"), rows.where(F.col("n") > PAIRWISE).drop("n")
        return self._parts

    def text_pairs(self, whole: bool = False) -> DataFrame:
        """(a, b): keys of different texts that share a span, those of crowds only with ``whole``."""
        small, large = self._split()
        s = _stretches(large, self.span).select("stretch", "key", "before").distinct()
        crowds = self._crowds().where(F.lit(not whole))
        few, many = s.join(crowds, "stretch", "left_anti"), s.join(crowds, "stretch")
        x, y = few.select("stretch", "key", "before").toDF("stretch", "a", "p"), few.select("stretch", "key", "before").toDF("stretch", "b", "q")
        head = (F.col("p") != F.col("q")) | (F.col("p") < 0)
        wide = x.join(y, "stretch").where((F.col("a") < F.col("b")) & head).select("a", "b")
        star = many.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
        return _compared(small, self.span, False).union(wide).union(star).distinct()

    def _crowds(self) -> DataFrame:
        """(stretch, lead): stretches of more than CROWD texts, with the smallest key among these."""
        one = _stretches(self._split()[1], self.span).select("stretch", "key").distinct()
        return one.groupBy("stretch").agg(F.count("*").alias("n"), F.min("key").alias("lead")).where(F.col("n") > CROWD).select("stretch", "lead")

    def crowds(self) -> DataFrame:
        """(doc, class_id) of the records in stretches of more than CROWD texts, which pairs link to one of them only."""
        found = _stretches(self._split()[1], self.span).join(self._crowds(), "stretch").select("key", "stretch").distinct()
        return self.members.join(found, "key").select("doc", F.col("stretch").alias("class_id")).distinct()

    def pairs(self, first: str, second: str, whole: bool = False) -> DataFrame:
        """Pairs of records, the smaller id first, exact copies included.

        A class of more than EXPAND exact copies stands for itself by its smallest id and is
        linked to each of its copies; :meth:`copies` has its members. Where more than CROWD texts
        have one stretch in common, each is linked to one of them; :meth:`crowds` has them all. With
        ``whole`` the different texts of crowds are paired too, quadratic in the largest.
        """
        few = F.col("copies") <= EXPAND
        member = self.members.join(self.classes, "key").where(few | (F.col("doc") == F.col("rep"))).select("key", "doc")
        across = self.text_pairs(whole).join(member.toDF("a", "x"), "a").join(member.toDF("b", "y"), "b").select("x", "y")
        repeated = self.members.join(self.classes.where(F.col("copies") > 1), "key")
        star = repeated.where(~few & (F.col("doc") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("doc").alias("y"))
        small = repeated.where(few).select("key", "doc")
        within = small.toDF("key", "x").join(small.toDF("key", "y"), "key").where(F.col("x") < F.col("y")).select("x", "y")
        both = across.union(star).union(within).where(F.col("x") != F.col("y"))
        return both.select(F.least("x", "y").alias(first), F.greatest("x", "y").alias(second)).distinct()

    def copies(self) -> DataFrame:
        """(doc, class_id, copies) of records whose whole text stands in another record."""
        many = self.classes.where(F.col("copies") > 1)
        return self.members.join(many, "key").select("doc", F.col("rep").alias("class_id"), "copies")

    def covered(self) -> DataFrame:
        """(doc, shared): code points of each record that lie in a shared span; 0 is left out."""
        small, large = self._split()
        s = _stretches(large, self.span)
        both = s.groupBy("stretch").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("stretch")
        wide = s.join(both, "stretch", "left_semi").select("key", F.col("begin").alias("low"), (F.col("begin") + self.span).alias("high"))
        pieces = _compared(small, self.span, True).union(wide)
        lists = pieces.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("p"))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

        def add(acc: Column, x: Column) -> Column:
            end = F.greatest(acc["end"], x["high"])
            return F.struct(end.alias("end"), (acc["sum"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["low"]))).alias("sum"))

        found = lists.select("key", F.aggregate("p", start, add)["sum"].alias("found"))
        texts = self.rows.select("key", "doc", F.length("text").cast("long").alias("n")).distinct().join(self.classes, "key")
        whole = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("found", F.lit(0)))
        return texts.join(found, "key", "left").select("doc", whole.alias("shared")).where("shared > 0")
