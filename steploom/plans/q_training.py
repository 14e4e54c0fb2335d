"""Queries over losses, metric logs and scaling curves, and the streaming pipelines on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.operators import losses, scaling
from steploom.plans import views
from steploom.sources import read_table
from steploom.streaming import pipelines

S = views.STEPS_SQL


def kto_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step losses from success rates as log-ratios, mean per trajectory."""
    s = views.steps(spark, sf_dir).where("mc_before is not null and mc_after is not null and not isnan(mc_before) and not isnan(mc_after)")
    ratio = 20 * (F.col("mc_after") - F.col("mc_before"))
    one = losses.kto_loss(ratio, F.lit(0.5), F.col("mc_after") >= F.col("mc_before") * 0.5, beta=0.3)
    return s.groupBy("trajectory_id").agg(F.count("*").alias("n_steps"), F.round(F.avg(one), 6).alias("loss"))


_KTO_SQL = f"""with {S}, r as (select trajectory_id, greatest(-10, least(10, 20 * (mc_after - mc_before))) as r, mc_after >= mc_before * 0.5 as good from steps where mc_before is not null and mc_after is not null and not isnan(mc_before) and not isnan(mc_after))
select trajectory_id, count(*) as n_steps, round(avg(case when good then 1 - 1 / (1 + exp(-0.3 * (r - 0.5))) else 1 - 1 / (1 + exp(-0.3 * (0.5 - r))) end), 6) as loss from r group by trajectory_id"""


def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair losses and margins per source from both sides' F1 as log-ratios."""
    p = read_table(spark, sf_dir, "preference_pairs").where("chosen_f1 is not null and rejected_f1 is not null and not isnan(chosen_f1) and not isnan(rejected_f1)")
    c, r = F.col("chosen_f1") * 10, F.col("rejected_f1") * 10
    return p.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(losses.dpo_loss(c, r, 0.5)), 6).alias("loss"), F.round(F.avg(0.5 * (c - r)), 6).alias("margin"), F.round(F.avg((c > r).cast("double")), 6).alias("accuracy"))


_DPO_SQL = """select source, count(*) as n, round(avg(ln(1 + exp(-5 * (chosen_f1 - rejected_f1)))), 6) as loss, round(avg(5 * (chosen_f1 - rejected_f1)), 6) as margin, round(avg(cast(chosen_f1 > rejected_f1 as integer)), 6) as accuracy
from preference_pairs where chosen_f1 is not null and rejected_f1 is not null and not isnan(chosen_f1) and not isnan(rejected_f1) group by source"""


def loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, lowest, highest and mean value of every user's event log."""
    e = read_table(spark, sf_dir, "events")
    return losses.loss_history(e, "user_id", "event_id", "value")


_HISTORY_SQL = """select user_id, count(*) as n, round(arg_min(value, event_id), 6) as first, round(arg_max(value, event_id), 6) as last, round(min(value), 6) as lowest, round(max(value), 6) as highest, round(avg(value), 6) as mean,
round(100 * (arg_min(value, event_id) - arg_max(value, event_id)) / nullif(arg_min(value, event_id), 0), 6) as reduction_pct from events group by user_id"""


def loss_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and extremes of the last ten values of every user."""
    e = losses.recent_window(read_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return e.select("event_id", F.round("recent_avg", 6).alias("recent_avg"), "recent_min", "recent_max")


_WINDOW_SQL = "select event_id, round(avg(value) over w, 6) as recent_avg, min(value) over w as recent_min, max(value) over w as recent_max from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)"


def lagged_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline before and exponential average after every event of a user."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") - 50) * 0.7310585786300049).alias("v"))
    out = losses.lagged_ema(e, "user_id", "event_id", "v")
    return out.select("user_id", "event_id", F.round("z0", 5).alias("z0"), F.round("ema", 5).alias("ema"))


_EMA_SQL = """with e as (select user_id, event_id, (value - 50) * cast('0.7310585786300049' as double) as v, row_number() over (partition by user_id order by event_id) as i from events),
m as (select a.user_id, a.event_id, sum(0.1 * power(0.9, a.i - b.i) * b.v) as ema, coalesce(sum(case when b.i < a.i then 0.1 * power(0.9, a.i - 1 - b.i) * b.v end), 0) as before from e a join e b on a.user_id = b.user_id and b.i <= a.i group by 1, 2)
select user_id, event_id, round(greatest(0, before), 5) + 0.0 as z0, round(ema, 5) as ema from m"""


def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event after 30 at which a user's log shows a collapse."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 50).alias("loss"), (F.col("value") - F.col("event_id") % 100).alias("kl"))
    return losses.collapsed_at(e, "user_id", "event_id", "loss", "kl")


_COLLAPSE_SQL = """select user_id, event_id as step, reason from (select user_id, event_id, case when value / 50 < 0.05 then 'loss' else 'kl' end as reason, row_number() over (partition by user_id order by event_id) as r from events
where event_id >= 30 and (value / 50 < 0.05 or value - event_id % 100 < -5)) where r = 1"""


def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and type, side by side."""
    e = read_table(spark, sf_dir, "events")
    kinds = ("click", "view", "purchase", "error", "signup")
    counts = [F.count_if(F.col("event_type") == k).alias(k) for k in kinds]
    return e.groupBy("user_id").agg(*counts, F.count("*").alias("total"))


_HISTOGRAM_SQL = "select user_id, " + ", ".join(f"count(*) filter (where event_type = '{k}') as {k}" for k in ("click", "view", "purchase", "error", "signup")) + ", count(*) as total from events group by user_id"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority a curve over order years: orders so far against their mean price."""
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1000).alias("metric")).withColumn("size", F.col("n") * (F.col("y") - 1990))


_POINTS = "points as (select o_orderpriority, n * (y - 1990) as size, metric, y from (select o_orderpriority, year(o_orderdate) as y, count(*) as n, avg(o_totalprice) / 1000 as metric from orders group by 1, 2))"


def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power law of metric over size per order priority."""
    return scaling.fit_power_law(_points(spark, sf_dir), "o_orderpriority", "size", "metric")


_FIT_SQL = f"""with {_POINTS}, f as (select o_orderpriority, count(*) as n, regr_slope(ln(metric), ln(size)) as b, regr_intercept(ln(metric), ln(size)) as la, avg(metric) as ay from points group by 1)
select o_orderpriority, f.n, round(exp(la), 6) as a, round(b, 6) as b, 0.0 as c, round(1 - sum(power(metric - exp(la) * power(size, b), 2)) / sum(power(metric - ay, 2)), 6) as r2 from points join f using (o_orderpriority) group by o_orderpriority, f.n, la, b"""


def checkpoint_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last point of every curve."""
    return scaling.compare_checkpoints(_points(spark, sf_dir), "o_orderpriority", "size", "metric")


_COMPARE_SQL = f"""with {_POINTS} select o_orderpriority, min(size) as first_size, max(size) as last_size, round(arg_min(metric, row(size, metric)), 6) as first_value, round(arg_max(metric, row(size, metric)), 6) as last_value,
round(100 * (arg_max(metric, row(size, metric)) - arg_min(metric, row(size, metric))) / abs(arg_min(metric, row(size, metric))), 6) as improvement_pct from points group by 1"""


def resume_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each curve point with the one before it."""
    p = _points(spark, sf_dir).select("o_orderpriority", "y", F.concat(F.lit("ckpt-"), F.col("y").cast("string")).alias("name"))
    return scaling.resume_chain(p, "o_orderpriority", "y").select("o_orderpriority", "name", "resume_from")


_CHAIN_SQL = f"with {_POINTS} select o_orderpriority, 'ckpt-' || y as name, 'ckpt-' || lag(y) over (partition by o_orderpriority order by y) as resume_from from points"


# ------------------------------------------------------------------ streams


BATCHES = 3


def _events(spark: SparkSession, sf_dir: str, order: Column, repeated: bool = False) -> DataFrame:
    """Events as a stream of BATCHES micro-batches, which arrive by ``order``; their time with a zone."""
    rows = read_table(spark, sf_dir, "events")
    path, files = pipelines.arrivals(rows, order, BATCHES, repeated)
    return pipelines.file_stream(spark, path, rows.schema, files).withColumn("ts", F.col("ts").cast("timestamp"))


def _late() -> Column:
    """Arrival up to three hours after the event, so that events overtake each other."""
    return F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(3 * 3600)) * 1_000_000


def _anyhow() -> Column:
    """Arrival in no order at all."""
    return F.pmod(F.xxhash64("event_id"), F.lit(1_000_003))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, by id, though a third of them is delivered twice."""
    rows = pipelines.deduplicated(_events(spark, sf_dir, _late(), repeated=True), "event_id", "ts", "3650 days")
    return pipelines.run_to_end(rows.select("event_id", "user_id", "event_type"))


def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count and sum per event type."""
    out = pipelines.run_to_end(pipelines.running_totals(_events(spark, sf_dir, _anyhow()), "event_type", "value"), "update", keys=["event_type"])
    return out.select("event_type", "n", F.round("total", 2).alias("total"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day, all windows so far."""
    w = pipelines.windowed_counts(_events(spark, sf_dir, _late()), "ts", "event_type", "value", "1 day", "6 hours")
    out = pipelines.run_to_end(w, "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_windows_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day, each window once, when the watermark has passed its end."""
    w = pipelines.windowed_counts(_events(spark, sf_dir, _late()), "ts", "event_type", "value", "1 day", "6 hours")
    out = pipelines.run_to_end(w)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits per user with values that purchases bring later, or sooner."""
    e = _events(spark, sf_dir, _anyhow()).select("user_id", F.when(F.col("event_type") == "purchase", "score").otherwise("visit").alias("kind"), "value")
    out = pipelines.run_to_end(pipelines.corrected_values(e, "user_id", "kind", "value"), "update", keys=["user_id"])
    return out.select("user_id", "visits", F.round("total", 2).alias("total"))


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential average of every user's values, by event id."""
    out = pipelines.run_to_end(pipelines.streaming_ema(_events(spark, sf_dir, F.col("event_id")), "user_id", "event_id", "value"), "update", keys=["user_id"])
    return out.select("user_id", "n", F.round("ema", 5).alias("ema"))


_STREAM_SQL = {
    "stream_append": "select distinct event_id, user_id, event_type from events",
    "stream_running": "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "stream_windows_closed": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 6 hours group by 1, 2",
    "stream_corrections": "select user_id, count(*) filter (where event_type is distinct from 'purchase') as visits, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0), 2) as total from events group by 1",
    "stream_ema": "with e as (select user_id, value, row_number() over (partition by user_id order by event_id desc) - 1 as i from events) select user_id, count(*) as n, round(sum(0.1 * power(0.9, i) * value), 5) as ema from e group by 1",
}

QUERIES = {
    "kto_loss": kto_loss, "dpo_loss": dpo_loss, "loss_history": loss_history, "loss_window": loss_window, "lagged_ema": lagged_ema, "collapse": collapse, "action_histogram": action_histogram, "scaling_fit": scaling_fit,
    "checkpoint_compare": checkpoint_compare, "resume_chain": resume_chain, "stream_append": stream_append, "stream_running": stream_running, "stream_windows": stream_windows, "stream_windows_closed": stream_windows_closed, "stream_corrections": stream_corrections, "stream_ema": stream_ema,
}
SQL = {
    "kto_loss": _KTO_SQL, "dpo_loss": _DPO_SQL, "loss_history": _HISTORY_SQL, "loss_window": _WINDOW_SQL, "lagged_ema": _EMA_SQL, "collapse": _COLLAPSE_SQL, "action_histogram": _HISTOGRAM_SQL, "scaling_fit": _FIT_SQL,
    "checkpoint_compare": _COMPARE_SQL, "resume_chain": _CHAIN_SQL, **_STREAM_SQL,
}
