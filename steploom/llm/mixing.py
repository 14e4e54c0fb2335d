"""Mixing sources to target weights under a budget and repetition limits.

Weights follow a temperature path: with the sources' own token shares p and target shares q,
``w(t) ~ q ** (1 - t) * p ** t``. At 0 these are the targets, at 1 the shares as they are. For a
budget that the targets can't fill within the repetition limits, the exponent is bisected to the
smallest that can. Without targets (q uniform) it is the usual tempered sampling ``p ** t``, and
the exponent can be bisected to a wanted entropy instead.

The weights are then realised exactly, not drawn: a source's records are permuted by hash in
blocks. Whole passes come first; of the last pass all blocks below a cut are used, and only inside
the cut block is a running sum taken. No step orders a whole source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = 4096


def tempered(shares: list[float], exponent: float, targets: list[float] | None = None) -> list[float]:
    """Normalised ``q ** (1 - t) * p ** t``; a source with no share or no target gets 0."""
    targets = targets or [1.0] * len(shares)
    on = [p > 0 and q > 0 for p, q in zip(shares, targets, strict=True)]
    logs = [(1 - exponent) * math.log(q) + exponent * math.log(p) if o else -math.inf for p, q, o in zip(shares, targets, on, strict=True)]
    top = max(logs, default=-math.inf)
    if top == -math.inf:
        return [0.0] * len(shares)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def entropy(weights: list[float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisect(inside, low: float, high: float) -> float:
    """The end of the interval in which ``inside`` holds, coming from ``high`` (where it holds)."""
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if inside(middle) else (middle, high)
    return high


def exponent_for_entropy(shares: list[float], wanted: float) -> float:
    """Exponent in [0, 1] at which ``p ** t`` has the wanted entropy (nearest end if out of reach)."""
    if entropy(tempered(shares, 0.0)) <= wanted:
        return 0.0
    if entropy(tempered(shares, 1.0)) >= wanted:
        return 1.0
    return _bisect(lambda t: entropy(tempered(shares, t)) <= wanted, 0.0, 1.0)


def exponent_for_limits(tokens: list[float], targets: list[float], limits: list[float], budget: float) -> float:
    """Smallest exponent in [0, 1] whose weights fill the budget within ``tokens * limits``."""
    total = sum(tokens) or 1.0
    shares = [x / total for x in tokens]

    def fits(t: float) -> bool:
        return all(w * budget <= n * k * (1 + 1e-12) for w, n, k in zip(tempered(shares, t, targets), tokens, limits, strict=True))

    if fits(0.0):
        return 0.0
    return _bisect(fits, 0.0, 1.0) if fits(1.0) else 1.0


def feasible_budget(tokens: list[float], weights: list[float], limits: list[float]) -> float:
    """Most tokens that can be drawn in exactly these proportions."""
    return min((n * k / w for n, w, k in zip(tokens, weights, limits, strict=True) if w > 0), default=0.0)


def plan_mix(tokens: list[float], targets: list[float], limits: list[float], budget: float | None = None, wanted_entropy: float | None = None) -> tuple[float, list[float], float]:
    """(exponent, weights, budget) for sources of these sizes.

    With ``wanted_entropy`` the weights are ``p ** t`` over the sources that have a target.
    Without a budget it is the largest at which the weights hold within the limits; a given
    budget that even the sources' own shares can't fill is cut to what they can.
    """
    total = sum(n for n, q in zip(tokens, targets, strict=True) if q > 0) or 1.0
    shares = [n / total if q > 0 else 0.0 for n, q in zip(tokens, targets, strict=True)]
    if wanted_entropy is not None:
        exponent = exponent_for_entropy([p for p in shares if p > 0], wanted_entropy)
        weights = tempered(shares, exponent)
    else:
        exponent = exponent_for_limits(tokens, targets, limits, budget) if budget is not None else 0.0
        weights = tempered(shares, exponent, targets)
    most = feasible_budget(tokens, weights, limits)
    return exponent, weights, most if budget is None else min(budget, most)


class Mix:
    """A mix of the records of ``df`` (record, source, n_tokens) towards ``targets``.

    ``targets`` has a row a source: (source, target_share, max_passes); it is a configuration
    table of bounded size and is collected. Records whose source is null or has no target, and
    records without tokens, are used 0 times. A target whose source has no tokens can't be met;
    its share goes to the others in proportion and is reported as 0. Null or negative targets and
    limits count as 0. Repeated rows are records of their own. Other columns of ``df`` are not
    read. ``df`` is read twice and should be stored if making it is dear.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, budget: float | None = None, wanted_entropy: float | None = None, seed: int = 7):
        spark = df.sparkSession
        place = F.xxhash64(F.lit(seed), F.col("record"))
        self.rows = df.select("record", "source", "n_tokens").withColumn("place", place).withColumn("block", F.pmod("place", F.lit(BLOCKS)).cast("int"))
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
            F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("q"), F.max(F.greatest(F.coalesce("max_passes", F.lit(0)), F.lit(0))).alias("k")
        )
        usable = self.rows.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
        blocks = usable.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("r"))
        blocks = blocks.join(F.broadcast(wanted), "source").withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("block")))
        blocks = blocks.persist()
        sizes = {r.source: (r.n, r.r) for r in blocks.groupBy("source").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).collect()}
        goals = sorted((r.source, float(r.q), int(r.k)) for r in wanted.collect())
        names = [g[0] for g in goals]
        tokens = [float(sizes.get(s, (0, 0))[0]) for s in names]
        q = [x if k > 0 else 0.0 for _, x, k in goals]
        limits = [float(k) for _, _, k in goals]
        self.exponent, weights, self.budget = plan_mix(tokens, q, limits, budget, wanted_entropy)
        plan = []
        for name, w, n, (_, target, k) in zip(names, weights, tokens, goals, strict=True):
            draw = w * self.budget
            full = min(k, int(draw // n + 1e-9)) if n else 0
            plan.append((name, target, k, w, n, sizes.get(name, (0, 0))[1], full, max(0.0, draw - full * n)))
        schema = "source string, target_share double, max_passes int, weight double, tokens double, records long, full int, rest double"
        self.plan = spark.createDataFrame(plan, schema)
        cuts = blocks.join(F.broadcast(self.plan.select("source", "rest")), "source").where(F.col("upto") > F.col("rest"))
        first = cuts.groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("c")).collect()
        blocks.unpersist()
        self.cuts = spark.createDataFrame([(r.source, r.c.block, float(r.c.before)) for r in first], "source string, cut int, before double")

    def passes(self) -> DataFrame:
        """The rows of ``df`` with ``passes``, how often each is used."""
        plan = self.plan.select("source", "full", "rest", "max_passes").join(self.cuts, "source", "left")
        rows = self.rows.join(F.broadcast(plan), "source", "left")
        usable = F.col("full").isNotNull() & (F.col("n_tokens") > 0)
        inside = rows.where(usable & (F.col("block") == F.col("cut")))
        order = Window.partitionBy("source", "block").orderBy("place", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a record goes in if more than half of it fits
        fits = F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.col("rest")
        cut = inside.withColumn("more", fits.cast("int"))
        others = rows.where(~usable | F.col("cut").isNull() | (F.col("block") != F.col("cut")))
        others = others.withColumn("more", F.when(usable & (F.col("rest") > 0), (F.col("cut").isNull() | (F.col("block") < F.col("cut"))).cast("int")).otherwise(0))
        used = cut.unionByName(others).withColumn("passes", F.when(usable, F.least("max_passes", F.col("full") + F.col("more"))).otherwise(0))
        return used.select("record", "source", "n_tokens", F.col("passes").cast("int").alias("passes"))

    def shares(self) -> DataFrame:
        """Per target source what was wanted and what the mix holds."""
        drawn = self.passes().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("passes")).alias("tokens_drawn"), F.max("passes").alias("most_passes"), F.sum((F.col("passes") > 0).cast("long")).alias("records_used")
        )
        drawn = drawn.join(F.broadcast(self.plan), "source", "right")
        all_drawn = F.sum(F.coalesce("tokens_drawn", F.lit(0))).over(Window.partitionBy())  # one row a target
        actual = F.coalesce("tokens_drawn", F.lit(0)) / F.greatest(all_drawn, F.lit(1))
        return drawn.select(
            "source", "target_share", F.round("weight", 6).alias("weight"), F.round(actual, 6).alias("actual_share"),
            F.col("tokens").cast("long").alias("tokens_available"), F.coalesce("tokens_drawn", F.lit(0)).cast("long").alias("tokens_drawn"),
            F.col("records").alias("records_available"), F.coalesce("records_used", F.lit(0)).cast("long").alias("records_used"), "max_passes", F.coalesce("most_passes", F.lit(0)).alias("most_passes"),
        )
