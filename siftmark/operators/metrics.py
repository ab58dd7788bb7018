"""Counters, histograms and the dashboard queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmark.plans.slices import order_key, previous_value, running_sum

# Default bucket bounds in ms, bands of the queue depth panel.
DEFAULT_BUCKETS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]
QUEUE_BANDS = [("green", 0), ("yellow", 5), ("red", 20)]
INF = "+Inf"


def request_counters(status: Column = None) -> dict[str, Column]:
    status = F.col("status") if status is None else status
    return {"http_requests_total": F.lit(True), "http_errors_total": status >= 500}


# Conditions of the event counters, by event name in the `type` column of a log.
EVENT_COUNTERS = {
    "jobs_queued_total": "queued", "jobs_completed_total": "completed", "jobs_failed_total": "failed",
    "evaluations_total": "evaluated", "entries_inserted_total": "inserted",
    "entries_verified_total": "verified", "verify_failed_total": "verify_failed",
    "notifications_sent_total": "notified",
}


def event_counters(kind: str = "type") -> dict[str, Column]:
    return {name: F.col(kind) == event for name, event in EVENT_COUNTERS.items()}


def service_counters(
    log: DataFrame, counters: dict[str, Column], keys: list[str], ts: str = "ts", window: str = "1 minute",
    latency: str | None = None,
) -> DataFrame:
    """One row per key and window with a count per counter, and the latency sum if there is one."""
    aggs = [F.count_if(cond).alias(name) for name, cond in counters.items()]
    if latency:
        aggs.append(F.sum(latency).alias("latency_sum"))
    out = log.groupBy(*keys, F.window(ts, window).alias("w")).agg(*aggs)
    return out.select(*keys, F.col("w.start").alias("window_start"), *[c for c in out.columns if c not in (*keys, "w")])


def counter_samples(counts: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counts per window as long rows (keys, metric, window_start, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in counters])
    return counts.select(*keys, "window_start", F.inline(cells))


def inflight(log: DataFrame, keys: list[str], ts: str, tie: str, latency_ms: str, parts: int | None = None) -> DataFrame:
    """Requests in flight after every start and end of a request; `ts` is the start."""
    end = F.col(ts) + F.make_dt_interval(secs=F.col(latency_ms) / 1000)
    moves = F.array(
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("move")), F.struct(end.alias("at"), F.lit(-1).alias("move")),
    )
    rows = log.select(*keys, tie, F.inline(moves))
    return running_sum(rows, keys, "at", ["move", tie], F.col("move"), "inflight", parts)


def latency_histogram(
    events: DataFrame, keys: list[str], value: str, buckets: list[float] | None = None,
) -> DataFrame:
    """Cumulative bucket counts as long rows (keys, le, bound, bucket_count, total_sum, total_count).

    One aggregate over scalars per bound, so the shuffle carries one row per key and task.
    """
    bounds = buckets or DEFAULT_BUCKETS
    v = F.col(value)
    agg = events.groupBy(*keys).agg(
        *[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.sum(v).alias("total_sum"), F.count(v).alias("total_count"),
    )
    cells = [
        F.struct(F.lit(f"{b:.0f}").alias("le"), F.lit(float(b)).alias("bound"), F.col(f"_b{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    cells.append(F.struct(F.lit(INF).alias("le"), F.lit(float("inf")).alias("bound"), F.col("total_count").alias("bucket_count")))
    return agg.select(*keys, F.inline(F.array(*cells)), "total_sum", "total_count")


def cumulate_buckets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per-bucket counts (keys, bound, n) to cumulative ones; a key has as many rows as bounds."""
    upto = Window.partitionBy(*keys).orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("bucket_count", F.sum("n").over(upto))


def quantile_of(series: Column, q: float) -> Column:
    """The q quantile of one histogram, given as array<struct<bound,c>> with cumulative counts c,
    by linear interpolation in the bucket that holds rank q * total.

    The lowest bucket starts at 0; in the +Inf bucket the highest finite bound is
    returned; no observations give null.
    """
    total = F.element_at(series, -1)["c"]
    rank = total * F.lit(float(q))
    i = F.size(F.filter(series, lambda b: b["c"] < rank))
    here, prev = F.get(series, i), F.get(series, i - 1)
    start, below = F.coalesce(prev["bound"], F.lit(0.0)), F.coalesce(prev["c"], F.lit(0.0))
    inside = here["c"] - below
    return (
        F.when(total == 0, F.lit(None).cast("double"))
        .when(here["bound"] == float("inf"), F.get(series, F.size(series) - 2)["bound"])
        .when((i == 0) & (here["bound"] <= 0), here["bound"])
        .when(inside == 0, here["bound"])
        .otherwise(start + (here["bound"] - start) * (rank - below) / inside)
    )


def histogram_quantile(buckets: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """One column per named quantile (`quantile_of`); `buckets` has bound and a cumulative
    bucket_count, one row per key and bound."""
    series = F.array_sort(F.collect_list(F.struct("bound", F.col("bucket_count").cast("double").alias("c"))))
    held = buckets.groupBy(*keys).agg(series.alias("_s"))
    return held.select(*keys, *[quantile_of(F.col("_s"), q).alias(name) for name, q in quantiles.items()])


def counter_increase(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tie: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds `increase` since the sample before; after a reset the value itself, null for the first."""
    out = previous_value(samples, keys, ts, list(tie), value, "_prev", parts)
    v, prev = F.col(value), F.col("_prev")
    return out.withColumn("increase", F.when(prev.isNotNull(), F.when(v < prev, v).otherwise(v - prev))).drop("_prev")


def counter_rate(
    samples: DataFrame, keys: list[str], window_seconds: int = 60, ts: str = "ts", value: str = "value",
    tie: tuple[str, ...] = (), parts: int | None = None,
) -> DataFrame:
    """Per-second increase of a counter per window."""
    inc = counter_increase(samples, keys, ts, value, tie, parts)
    out = inc.groupBy(*keys, F.window(ts, f"{window_seconds} seconds").alias("w")).agg(
        (F.coalesce(F.sum("increase"), F.lit(0.0)) / F.lit(float(window_seconds))).alias("rate")
    )
    return out.select(*keys, F.col("w.start").alias("window_start"), "rate")


def latest_value(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tie: tuple[str, ...] = ()) -> DataFrame:
    """The last sample of each series that is not null."""
    return samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, order_key(samples, ts, list(tie))).alias("latest"), F.max(ts).alias("at"),
    )


def band(value: Column, steps: list[tuple[str, float]] = QUEUE_BANDS) -> Column:
    """The name of the highest step reached; null below the first."""
    out = None
    for name, start in sorted(steps, key=lambda s: -s[1]):
        out = F.when(value >= start, name) if out is None else out.when(value >= start, name)
    return out


def queue_depth(
    moves: DataFrame, keys: list[str], ts: str, tie: str, move: Column, parts: int | None = None,
) -> DataFrame:
    """Adds `depth`, the running sum of +1 (enqueue) and -1 (dequeue)."""
    return running_sum(moves, keys, ts, [tie], move, "depth", parts)
