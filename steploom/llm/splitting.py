"""Splits of given proportions that keep related records together.

Records that share an entity, also through others, form a component. Components of the same size
and label profile are interchangeable and bundled. How many of each bundle go to each split is a
min-cost flow: whole shares are set, and the components left over by rounding are units that flow
from bundles to splits at convex costs for a split's deviation from its quota (in records, and in
positive records) and for the bundle's own deviation. Large components are placed first, so the
small ones even out what these cause. Within a bundle, a component's place in a hash order decides
its split.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.llm.components import components
from steploom.plans.storage import store

BLOCKS = 4096
EXACT = 64  # sizes up to this are bundled exactly, larger ones to a sixteenth of an octave
GIANT = 1000  # a component of more than one in so many records is a bundle of its own


@dataclass
class Arc:
    to: int
    room: int
    cost: float
    back: int


@dataclass
class Flow:
    """Min-cost flow by successive shortest paths."""

    nodes: int
    arcs: list[list[Arc]] = field(init=False)

    def __post_init__(self) -> None:
        self.arcs = [[] for _ in range(self.nodes)]

    def add(self, a: int, b: int, room: int, cost: float) -> Arc:
        forward = Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[a].append(forward)
        self.arcs[b].append(Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return forward

    def send(self, source: int, sink: int, units: int) -> float:
        """Sends ``units`` at least cost (Dijkstra on reduced costs after one Bellman-Ford)."""
        price = [math.inf] * self.nodes
        price[source] = 0.0
        for _ in range(self.nodes):
            moved = False
            for a in range(self.nodes):
                for arc in self.arcs[a]:
                    if arc.room and price[a] + arc.cost < price[arc.to] - 1e-12:
                        price[arc.to], moved = price[a] + arc.cost, True
            if not moved:
                break
        total = 0.0
        while units:
            far, via = [math.inf] * self.nodes, [None] * self.nodes
            far[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for arc in self.arcs[a]:
                    if arc.room and price[arc.to] < math.inf:
                        there = d + max(0.0, arc.cost + price[a] - price[arc.to])
                        if there < far[arc.to] - 1e-12:
                            far[arc.to], via[arc.to] = there, (a, arc)
                            heapq.heappush(heap, (there, arc.to))
            if far[sink] == math.inf:
                raise ValueError("the flow has no way left")
            price = [p + (d if d < math.inf else 0.0) for p, d in zip(price, far, strict=True)]
            room, at = units, sink
            while at != source:
                a, arc = via[at]
                room, at = min(room, arc.room), a
            at = sink
            while at != source:
                a, arc = via[at]
                arc.room -= room
                self.arcs[at][arc.back].room += room
                total += room * arc.cost
                at = a
            units -= room
        return total


def quotas(bundles: list[tuple[float, float, int]], proportions: list[float]) -> list[list[int]]:
    """Components of each bundle (size, positives, number) for each split.

    Whole shares are fixed; the units that rounding leaves over flow, one size class at a time
    from the largest down. A split of proportion 0 gets nothing.
    """
    whole = sum(proportions)
    p = [max(0.0, x) / whole for x in proportions]
    total = sum(s * n for s, _, n in bundles)
    positive = sum(g * n for _, g, n in bundles)
    out = [[math.floor(n * x + 1e-9) for x in p] for _, _, n in bundles]
    lack = [total * x for x in p]
    lack_positive = [positive * x for x in p]
    for (s, g, _), row in zip(bundles, out, strict=True):
        for j, k in enumerate(row):
            lack[j] -= s * k
            lack_positive[j] -= g * k
    classes: dict[float, list[int]] = {}
    for b, (s, _, n) in enumerate(bundles):
        if n > sum(out[b]):
            classes.setdefault(s, []).append(b)
    for size in sorted(classes, reverse=True):
        own = classes[size]
        left = [bundles[b][2] - sum(out[b]) for b in own]
        source, sink = 0, 1 + len(own) + len(p)
        flow = Flow(sink + 1)
        chosen: dict[tuple[int, int], Arc] = {}
        for k, b in enumerate(own):
            flow.add(source, 1 + k, left[k], 0.0)
            for j, x in enumerate(p):
                if x > 0:
                    # keeps a bundle near its own share, and positives where they lack
                    own_cost = -(bundles[b][2] * x - out[b][j]) / 4
                    label_cost = -math.copysign(min(1.0, abs(lack_positive[j]) / (size or 1)), lack_positive[j]) * (bundles[b][1] / (size or 1)) / 8
                    chosen[k, j] = flow.add(1 + k, 1 + len(own) + j, left[k], own_cost + label_cost)
        for j, x in enumerate(p):
            for unit in range(sum(left) if x > 0 else 0):
                before, after = lack[j] - size * unit, lack[j] - size * (unit + 1)
                # per unit of size: how much further from the quota this one more brings the split
                flow.add(1 + len(own) + j, sink, 1, 4 * (after * after - before * before) / max(size * size, 1e-9) / 2)
        flow.send(source, sink, sum(left))
        for (k, j), arc in chosen.items():
            used = left[k] - arc.room
            b = own[k]
            out[b][j] += used
            lack[j] -= used * size
            lack_positive[j] -= used * bundles[b][1]
    return out


class GroupedSplit:
    """Assigns entities to splits so that linked entities stay together.

    ``records`` has columns entity_a, entity_b (either may be null), positive (boolean); a record
    links its two entities. ``targets`` (split_name, proportion) is a configuration table of
    bounded size and is collected; null or negative proportions count as 0. Records without any
    entity are not assigned here. Repeated records count each. A third of all records in one
    entity is one component and can't be divided; the rest makes up for it as far as it can.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, seed: int = 11):
        spark = records.sparkSession
        a, b = F.col("entity_a"), F.col("entity_b")
        pairs = records.where(a.isNotNull() | b.isNotNull()).groupBy("entity_a", "entity_b").agg(
            F.count("*").alias("n"), F.sum(F.coalesce(F.col("positive"), F.lit(False)).cast("long")).alias("g")
        )
        pairs = store(pairs, "entity-pairs")
        self.linked = store(components(pairs.where(a != b).select("entity_a", "entity_b")), "components")
        entities = pairs.select(F.coalesce(a, b).alias("node"), "n", "g")
        others = pairs.where(a != b).select(b.alias("node"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("g"))
        sized = entities.union(others).groupBy("node").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        sized = sized.join(self.linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        self.entities = store(sized, "entities")
        total = self.entities.agg(F.sum("n")).first()[0] or 0
        whole = self.entities.groupBy("component").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        size = F.when(F.col("n") <= EXACT, F.col("n").cast("double")).otherwise(F.round(F.log2("n") * 16) / 16 + 1000)
        label = F.when(F.col("n") <= EXACT, F.col("g").cast("double")).otherwise(F.round(10 * F.col("g") / F.col("n")))
        own = F.when(F.col("n") * GIANT > total, F.col("component"))
        place = F.xxhash64(F.lit(seed), "component")
        whole = whole.select("component", "n", "g", size.alias("size"), label.alias("label"), own.alias("own"), place.alias("place"))
        whole = whole.withColumn("bundle", F.xxhash64("size", "label", F.coalesce("own", F.lit("")))).withColumn("block", F.pmod("place", F.lit(BLOCKS)).cast("int"))
        blocks = store(whole.groupBy("bundle", "block").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("g").alias("g")), "blocks")
        # bundles are bounded: a few thousand sizes and profiles, and fewer than GIANT of their own
        bundles = blocks.groupBy("bundle").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("g").alias("g")).orderBy("bundle").collect()
        wanted = sorted(((r.split_name, float(r.proportion or 0)) for r in targets.where("split_name is not null").collect()), key=lambda x: (-x[1], x[0]))
        self.names = [x[0] for x in wanted]
        counts = quotas([(r.n / r.c, r.g / r.c, r.c) for r in bundles], [x[1] for x in wanted]) if bundles else []
        cuts = [(r.bundle, [sum(q[: j + 1]) for j in range(len(q))]) for r, q in zip(bundles, counts, strict=True)]
        cut = spark.createDataFrame(cuts, "bundle long, upto array<long>")
        offsets = blocks.withColumn("before", F.sum("c").over(Window.partitionBy("bundle").orderBy("block")) - F.col("c")).select("bundle", "block", "before")
        ranked = whole.join(offsets, ["bundle", "block"]).join(F.broadcast(cut), "bundle")
        rank = F.col("before") + F.row_number().over(Window.partitionBy("bundle", "block").orderBy("place", "component"))
        ranked = ranked.withColumn("rank", rank)
        index = F.size(F.filter("upto", lambda u: u < F.col("rank")))
        split = F.get(F.array(*(F.lit(n) for n in self.names)), index)
        self.split = ranked.select("component", split.alias("split"))

    def assignment(self) -> DataFrame:
        """(entity, component, split) of every entity."""
        return self.entities.join(self.split, "component").select(F.col("node").alias("entity"), "component", "split")

    def linked_pairs(self, first: str, second: str, expand: int | None = 64) -> DataFrame:
        """Pairs of different entities that must share a split, the smaller first.

        Components of more than ``expand`` entities are given as pairs with their smallest entity; None
        gives every pair, quadratic in the largest component.
        """
        sizes = self.linked.groupBy("component").agg(F.count("*").alias("size"))
        rows = self.linked.join(sizes, "component")
        few = F.lit(True) if expand is None else F.col("size") <= expand
        small = rows.where(few).select("component", "node")
        pairs = small.toDF("component", "x").join(small.toDF("component", "y"), "component").where("x < y").select("x", "y")
        star = rows.where(~few & (F.col("node") != F.col("component"))).select(F.col("component").alias("x"), F.col("node").alias("y"))
        return pairs.union(star).toDF(first, second)
