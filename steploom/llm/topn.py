"""Top N items of every group by a sorted-run, loser-tree merge.

The number of buckets follows the size of the input, so a bucket is bounded and is merged by itself.
Every input partition is cut into bounded runs. A run is sorted by (group, score descending,
item ascending), stripped of repeats of an item within a group and of every row beyond the
N-th of its group (such a row can't be among the N best overall), and stored as one columnar
block per bucket of the group's hash. The only shuffle moves these blocks. Each bucket then
merges its runs with a loser tree; once a group has given N items, every run seeks past the
rest of that group by binary search, so a group of millions costs a merge of N rows a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_ROWS = 400_000
OUT_ROWS = 50_000
BUCKET_BYTES = 1 << 25  # bytes of input a bucket, by the plan's own estimate
UNKNOWN_BYTES = 1 << 60  # from here on the plan has no estimate, and rows are counted
ROW_BYTES = 64


class LoserTree:
    """Tournament over k cursors: ``winner`` is the cursor with the smallest key.

    Inner nodes keep the loser of their match, so replacing the winner's key replays one path of
    log2(k) matches. An exhausted cursor has the key None, which loses against everything.
    """

    def __init__(self, keys: list):
        self.k = max(1, len(keys))
        self.keys = list(keys) or [None]
        self.losers = [-1] * self.k
        self.winner = 0
        for leaf in range(self.k):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _enter(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = leaf
                return
            if self._beats(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node //= 2
        self.winner = leaf

    def replace(self, key) -> None:
        """Gives the winner's cursor its next key and finds the new winner."""
        leaf = self.winner
        self.keys[leaf] = key
        node = (leaf + self.k) // 2
        while node:
            if self._beats(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node //= 2
        self.winner = leaf


def sorted_run(table: pa.Table, n: int) -> pa.Table:
    """One run: a row per (group, item) at its best score, at most ``n`` rows a group, in order."""
    best = table.group_by(["bucket", "g", "i"]).aggregate([("s", "max")])
    best = best.select(["bucket", "g", "i", "s_max"]).rename_columns(["bucket", "g", "i", "s"])
    best = best.sort_by([("bucket", "ascending"), ("g", "ascending"), ("s", "descending"), ("i", "ascending")])
    if not best.num_rows:
        return best
    codes = pc.run_end_encode(best["g"].combine_chunks())
    ends = np.asarray(codes.run_ends)
    starts = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    keep = np.arange(best.num_rows) - starts < n
    return best.filter(pa.array(keep))


def merge_runs(runs: list[tuple[list, list, list]], n: int) -> Iterator[tuple[str, str, float, int]]:
    """(group, item, score, rank) of the ``n`` best of every group over sorted runs of (groups, scores, items)."""
    at = [0] * len(runs)

    def key(r: int):
        groups, scores, items = runs[r]
        p = at[r]
        return (groups[p], -scores[p], items[p]) if p < len(groups) else None

    tree = LoserTree([key(r) for r in range(len(runs))])
    group, seen, done = None, set(), True
    while (head := tree.keys[tree.winner]) is not None:
        r = tree.winner
        if head[0] != group:
            group, seen = head[0], set()
        done = len(seen) >= n
        if done:
            # seek: the group is complete, skip what this run still holds of it
            lo, hi, groups = at[r], min(at[r] + n, len(runs[r][0])), runs[r][0]
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if groups[mid] > group else (mid + 1, hi)
            at[r] = lo
        else:
            if head[2] not in seen:
                seen.add(head[2])
                yield group, head[2], -head[1], len(seen)
            at[r] += 1
        tree.replace(key(r))


def top_n_per_group(
    df: DataFrame, group: str, score: str, item: str, n: int, buckets: int | None = None, run_rows: int = RUN_ROWS
) -> DataFrame:
    """The ``n`` items of highest score of every group: columns (``group``, ``item``, ``score``, ``rank``).

    An item counts once a group, by its highest score. Of equal scores the smaller item (string
    order) goes first, so the result doesn't depend on partitioning. Rows whose group, item or
    score is null, or whose score is NaN, are left out; a group without any usable row has no
    rows. -0.0 equals 0.0. Other columns of ``df`` are not read, whatever they are called. An
    empty input gives no rows.
    """
    spark = df.sparkSession
    if buckets is None:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if estimate >= UNKNOWN_BYTES:
            estimate = ROW_BYTES * df.count()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimate // BUCKET_BYTES))
    value = F.col(f"`{score}`").cast("double") + F.lit(0.0)
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{item}`").cast("string").alias("i"), value.alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    rows = rows.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket"), "g", "i", "s")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            run = sorted_run(pa.Table.from_batches(held), n)
            marks = np.asarray(run["bucket"])
            cuts = np.flatnonzero(np.diff(marks)) + 1
            spans = list(zip([0, *cuts], [*cuts, len(marks)], strict=True)) if len(marks) else []
            blocks = []
            for a, b in spans:
                sink = pa.BufferOutputStream()
                part = run.slice(a, b - a).select(["g", "s", "i"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                blocks.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([int(marks[a]) for a, _ in spans], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "run"]
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= run_rows:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [run.as_buffer() for batch in batches for run in batch.column(1)]
        tables = [pa.ipc.open_stream(run).read_all() for run in runs]
        merged = merge_runs([tuple(t[c].to_pylist() for c in ("g", "s", "i")) for t in tables], n)
        while out := list(islice(merged, OUT_ROWS)):
            g, i, s, k = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64()), pa.array(k, pa.int32())],
                ["g", "i", "s", "k"],
            )

    stored = rows.mapInArrow(build, "bucket int, run binary").repartitionById(buckets, "bucket")
    best = stored.mapInArrow(merge, "g string, i string, s double, k int")
    return best.toDF(group, item, score, "rank")
