"""Rates, errors and latency quantiles of a live request log.

`stream_metrics` is one streaming aggregate. `run_metrics` keeps everything: rows behind the watermark go to a
side table with their reason, and the counts of each micro-batch are stored in a form that can be added up, so
that a repair run can merge the late rows in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmark.operators.metrics import DEFAULT_BUCKETS, quantile_of
from siftmark.plans.slices import micros
from siftmark.streaming import batches


def _partials(log: DataFrame, keys: list[str], ts: str, latency: str, error: Column | None, window_seconds: int, bounds: list[float]) -> DataFrame:
    """Counters per key and window that can be added up."""
    v = F.col(latency)
    bad = F.col("status") >= 500 if error is None else error
    return log.groupBy(*keys, F.window(ts, f"{window_seconds} seconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(bad).alias("errors"),
        *[F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.sum(v).alias("latency_sum"), F.count(v).alias("latency_count"),
    )


def _finished(counts: DataFrame, keys: list[str], start: Column, window_seconds: int, bounds: list[float], quantiles: tuple[float, ...]) -> DataFrame:
    cells = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"_b{i}").cast("double").alias("c")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("bound"), F.col("latency_count").cast("double").alias("c")))
    out = counts.withColumn("buckets", F.array(*cells))
    per_second = lambda c: (F.col(c) / F.lit(float(window_seconds))).alias(f"{c}_per_second")
    return out.select(
        *keys, start.alias("window_start"), "requests", "errors", per_second("requests"), per_second("errors"),
        "latency_sum", "latency_count", "buckets",
        *[quantile_of(F.col("buckets"), q).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def stream_metrics(
    log: DataFrame, keys: list[str], ts: str = "ts", latency: str = "latency_ms", error: Column | None = None,
    window_seconds: int = 60, watermark: str = "10 minutes", quantiles: tuple[float, ...] = (0.5, 0.99),
    buckets: list[float] | None = None,
) -> DataFrame:
    """One row per key and window. Rows later than the watermark are left out; `run_metrics` keeps them.

    The state is one row of counters per key and open window. The same call on a
    batch frame gives the same rows.
    """
    bounds = buckets or DEFAULT_BUCKETS
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    counts = _partials(timed, keys, ts, latency, error, window_seconds, bounds)
    return _finished(counts, keys, F.col("_w.start"), window_seconds, bounds, quantiles)


def run_metrics(
    log: DataFrame, keys: list[str], out: str, checkpoint: str, ts: str = "ts", latency: str = "latency_ms",
    error: Column | None = None, window_seconds: int = 60, delay_seconds: float = 600,
    buckets: list[float] | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Counts of each micro-batch to `out`/partials, rows behind the watermark to `out`/late with their `reason`.

    The watermark of a batch is the highest time of the batches before it less the delay. Rows without a time are
    late as well. `read_metrics` adds the counts up.
    """
    bounds = buckets or DEFAULT_BUCKETS

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = batches.mark_before(spark, out, batch_id)
        judged = batch.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("reason", batches.lateness(F.col(ts), before))
        batches.write_batch(judged, out, "arrived", batch_id)
        arrived = batches.read_batch(spark, out, "arrived", batch_id, judged.schema)
        batches.write_batch(arrived.where("reason IS NOT NULL"), out, "late", batch_id)
        counts = _partials(arrived.where("reason IS NULL").drop("reason"), keys, ts, latency, error, window_seconds, bounds)
        counts = counts.withColumn("window_start", F.col("_w.start")).drop("_w")
        batches.write_batch(counts, out, "partials", batch_id)
        batches.move_mark(spark, out, batch_id, before, arrived.agg(F.max(micros(F.col(ts)))).first()[0], delay_seconds)

    writer = log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that `run_metrics` left out, with `reason` and `batch_id`."""
    return batches.read_output(spark, out, "late")


def read_metrics(
    spark: SparkSession, out: str, keys: list[str], ts: str = "ts", latency: str = "latency_ms", error: Column | None = None,
    window_seconds: int = 60, quantiles: tuple[float, ...] = (0.5, 0.99), buckets: list[float] | None = None, repaired: bool = False,
) -> DataFrame:
    """One row per key and window over all batches; `repaired` adds the late rows that have a time."""
    bounds = buckets or DEFAULT_BUCKETS
    counts = batches.read_output(spark, out, "partials").drop(batches.BATCH)
    if repaired:
        late = _partials(late_rows(spark, out).where("reason = 'late'"), keys, ts, latency, error, window_seconds, bounds)
        counts = counts.unionByName(late.withColumn("window_start", F.col("_w.start")).drop("_w"))
    added = [c for c in counts.columns if c not in (*keys, "window_start")]
    total = counts.groupBy(*keys, "window_start").agg(*[F.sum(c).alias(c) for c in added])
    return _finished(total, keys, F.col("window_start"), window_seconds, bounds, quantiles)
