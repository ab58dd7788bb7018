"""Streaming forms of result reuse and job progress, with their state in tables.

The outcome of an event depends on the events of its key before it, so events are decided in time order, once
the watermark has passed them. Every micro-batch runs the batch form on what the watermark has released: the
rows that waited, the rows that came, and one row per key for what went before. Files may arrive in any order
within the delay; rows behind the watermark go to a side table with their reason.

Tables under `out`, a folder per batch: held (came or waiting), late, outcome, state, clock. A batch that runs
again reads what the batch before left and replaces its own folders. No task holds the rows of a key: the batch
forms cut hot keys themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from siftmark.operators import sequences
from siftmark.plans.slices import micros
from siftmark.streaming import batches

_OLD = "_old"  # marks the rows that stand for what went before

# step(rows) adds an outcome to rows in time order, keep(outcome, mark) picks the rows that later events depend on.
Step = Callable[[DataFrame], DataFrame]
Keep = Callable[[DataFrame, int], DataFrame]


_FIRST, _END = -(1 << 62), 1 << 62  # watermarks before all and behind all times


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def _decide(spark: SparkSession, held: DataFrame, mark: int, batch_id: int, out: str, ts: str, step: Step, keep: Keep) -> None:
    """Outcome and new state of the rows that the watermark has released."""
    old = batches.read_batch(spark, out, "state", batch_id - 1, held.schema).withColumn(_OLD, F.lit(True))
    released = held.where(micros(F.col(ts)) <= mark).withColumn(_OLD, F.lit(False))
    decided = step(released.unionByName(old))
    batches.write_batch(decided, out, "outcome", batch_id)
    decided = batches.read_batch(spark, out, "outcome", batch_id, decided.schema)
    batches.write_batch(keep(decided, mark).select(*held.columns), out, "state", batch_id)


def _waiting(spark: SparkSession, schema: T.StructType, batch_id: int, out: str, ts: str, before: int | None) -> DataFrame:
    """Rows of earlier batches that the watermark had not released."""
    held = batches.read_batch(spark, out, "held", batch_id - 1, schema)
    return held.where(micros(F.col(ts)) > (_FIRST if before is None else before))


def _run(events: DataFrame, out: str, checkpoint: str, ts: str, step: Step, keep: Keep, delay_seconds: float, available_now: bool) -> StreamingQuery:
    schema = _schema(events)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = batches.mark_before(spark, out, batch_id)
        judged = batch.withColumn("reason", batches.lateness(F.col(ts), before))
        batches.write_batch(judged, out, "arrived", batch_id)
        judged = batches.read_batch(spark, out, "arrived", batch_id, _schema(judged))
        batches.write_batch(judged.where("reason IS NOT NULL"), out, "late", batch_id)
        came = judged.where("reason IS NULL").drop("reason")
        batches.write_batch(_waiting(spark, schema, batch_id, out, ts, before).unionByName(came), out, "held", batch_id)
        held = batches.read_batch(spark, out, "held", batch_id, schema)
        highest = held.agg(F.max(micros(F.col(ts)))).first()[0]
        mark = batches.move_mark(spark, out, batch_id, before, highest, delay_seconds)
        _decide(spark, held, _FIRST if mark is None else mark, batch_id, out, ts, step, keep)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _end(events: DataFrame, out: str, ts: str, step: Step, keep: Keep) -> None:
    """Decide what still waits, once the stream has ended."""
    spark, schema = events.sparkSession, _schema(events)
    last = batches.read_output(spark, out, "clock").agg(F.max(batches.BATCH)).first()[0]
    before = batches.mark_before(spark, out, last + 1)
    if before is not None and before >= _END:
        return
    batches.write_batch(_waiting(spark, schema, last + 1, out, ts, before), out, "held", last + 1)
    _decide(spark, batches.read_batch(spark, out, "held", last + 1, schema), _END, last + 1, out, ts, step, keep)
    batches.move_mark(spark, out, last + 1, None, _END, 0)


def read_outcome(spark: SparkSession, out: str) -> DataFrame:
    """All decided rows."""
    return batches.read_output(spark, out, "outcome").where(~F.col(_OLD)).drop(_OLD, batches.BATCH)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came behind the watermark or without a time, with `reason` and `batch_id`."""
    return batches.read_output(spark, out, "late")


class ReuseStream:
    """Result reuse over a stream; `read_outcome` gives (keys, tie, ts, reused), as `sequences.reuse_results`."""

    def __init__(self, keys: list[str], ts: str, tie: str, out: str, ttl_seconds: float = 7200, delay_seconds: float = 600):
        self.keys, self.ts, self.tie, self.out, self.ttl_seconds, self.delay_seconds = keys, ts, tie, out, ttl_seconds, delay_seconds

    def _narrow(self, jobs: DataFrame) -> DataFrame:
        return jobs.select(*self.keys, self.tie, F.col(self.ts).cast("timestamp").alias(self.ts))

    def _step(self, rows: DataFrame) -> DataFrame:
        # The last event that started a period starts it again: it is the first of its key.
        return sequences.reuse_results(rows, self.keys, self.ts, self.tie, self.ttl_seconds)

    def _keep(self, decided: DataFrame, mark: int) -> DataFrame:
        ttl = int(self.ttl_seconds * 1_000_000)
        last = decided.where(~F.col("reused")).groupBy(*self.keys).agg(F.max(self.ts).alias(self.ts))
        none = F.lit(None).cast(decided.schema[self.tie].dataType).alias(self.tie)
        return last.where(micros(F.col(self.ts)) > mark - ttl).withColumn(self.tie, none)

    def start(self, jobs: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        return _run(self._narrow(jobs), self.out, checkpoint, self.ts, self._step, self._keep, self.delay_seconds, available_now)

    def end(self, jobs: DataFrame) -> None:
        """Decide what still waits; `jobs` is the stream, for its columns."""
        _end(self._narrow(jobs), self.out, self.ts, self._step, self._keep)


class ProgressStream:
    """Job progress over a stream; `read_outcome` gives (job, type, at, id) up to each job's first terminal event.

    That a job has ended is remembered for `keep_seconds` of event time.
    """

    def __init__(
        self, out: str, job: str = "job_id", kind: str = "type", at: str = "at", tie: str = "id",
        terminal: tuple[str, ...] = ("done", "failed"), delay_seconds: float = 600, keep_seconds: float = 86400,
    ):
        self.out, self.job, self.kind, self.at, self.tie = out, job, kind, at, tie
        self.terminal, self.delay_seconds, self.keep_seconds = terminal, delay_seconds, keep_seconds

    def _narrow(self, events: DataFrame) -> DataFrame:
        return events.select(self.job, self.kind, F.col(self.at).cast("timestamp").alias(self.at), self.tie)

    def _step(self, rows: DataFrame) -> DataFrame:
        return sequences.job_progress(rows, self.job, self.kind, self.at, self.tie, self.terminal)

    def _keep(self, decided: DataFrame, mark: int) -> DataFrame:
        ended = decided.where(F.col(self.kind).isin(*self.terminal))
        return ended.where(micros(F.col(self.at)) > mark - int(self.keep_seconds * 1_000_000))

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        return _run(self._narrow(events), self.out, checkpoint, self.at, self._step, self._keep, self.delay_seconds, available_now)

    def end(self, events: DataFrame) -> None:
        """Decide what still waits; `events` is the stream, for its columns."""
        _end(self._narrow(events), self.out, self.at, self._step, self._keep)


def stream_latest_status(events: DataFrame, job: str = "job_id", kind: str = "type", at: str = "at", tie: str = "id") -> DataFrame:
    """The last event type of each job, for output mode update or complete."""
    when = F.struct(F.col(at), F.col(tie))
    return events.groupBy(job).agg(F.max_by(kind, when).alias("status"), F.max(at).alias("since"))
