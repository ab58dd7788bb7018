"""Files that keep arriving: the batch scan per micro-batch, with repeatable writes.

A micro-batch stores its findings, and what a job's summary needs of them in a form that can be added up: counts
by severity and category, and the first findings where there is a limit. These tables lie in buckets of job ids.
Closing a job adds up its partial rows; it reads no finding and no bucket without a job that it closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from siftmark import schemas
from siftmark.operators import audit, export, rollup
from siftmark.operators.scan import ScanOptions, scan_files
from siftmark.plans.scan_job import spread, verdict_of
from siftmark.plans.shared import exists
from siftmark.sources.rules import Rule
from siftmark.streaming.batches import BATCH, read_output, write_batch  # noqa: F401

BUCKETS = 256
_SEEN = "_seen_at"
_PARTIAL = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("seen_at", T.TimestampType()),
])


def bucket_of(job: Column) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def write_bucketed(df: DataFrame, out: str, name: str, batch_id: int) -> None:
    """Rows with job_id to `name`/bucket/batch; a batch that runs again replaces its folders. Hot buckets are split over tasks."""
    placed = df.withColumn("bucket", bucket_of(F.col("job_id"))).withColumn(BATCH, F.lit(batch_id).cast("long"))
    placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", BATCH).parquet(f"{out}/{name}")


def read_bucketed(spark: SparkSession, out: str, name: str, schema: T.StructType, jobs: DataFrame | None = None) -> DataFrame:
    """The rows of a bucketed table with `batch_id`; of the jobs' buckets only, if jobs are given."""
    base = f"{out}/{name}"
    paths = [base]
    if jobs is not None:  # at most BUCKETS numbers
        found = jobs.select(bucket_of(F.col("job_id")).alias("b")).distinct().collect()
        paths = [f"{base}/bucket={r.b}" for r in found]
    paths = [p for p in paths if exists(spark, p)]
    placed = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField(BATCH, T.LongType())])
    if not paths:
        return spark.createDataFrame([], placed).drop("bucket")
    return spark.read.schema(placed).option("basePath", base).parquet(*paths).drop("bucket")


def stream_scan(
    files: DataFrame, rules: list[Rule], out: str, checkpoint: str, opts: ScanOptions = ScanOptions(),
    available_now: bool = False,
) -> StreamingQuery:
    """Findings and partial summaries of each micro-batch. The files of a job may arrive in any number of batches;
    what concerns a job as a whole is made by `close_jobs` once they are all there."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = scan_files(spread(batch.drop(_SEEN)) if opts.spread else batch.drop(_SEEN), rules, opts)
        write_bucketed(found, out, "findings", batch_id)
        own = read_bucketed(spark, out, "findings", schemas.FINDINGS).where(F.col(BATCH) == batch_id).drop(BATCH)
        jobs = batch.groupBy("job_id").agg(F.max(_SEEN).alias("seen_at"))
        counts = rollup.count_findings(own).withColumnRenamed("job_id", "_job")
        partial = jobs.join(counts, F.col("job_id").eqNullSafe(F.col("_job")), "left").fillna(0, ["n"])
        write_bucketed(partial.select(*_PARTIAL.names), out, "partials", batch_id)
        if opts.max_findings > 0:
            write_bucketed(rollup.cap_findings(own, opts.max_findings).drop("rank"), out, "first", batch_id)

    # The time of a batch is kept with its offsets, so a batch that runs again has the same.
    timed = files.withColumn(_SEEN, F.current_timestamp())
    writer = timed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_findings(spark: SparkSession, out: str, jobs: DataFrame | None = None) -> DataFrame:
    """All findings with `batch_id`, or those of the given jobs, read from their buckets."""
    found = read_bucketed(spark, out, "findings", schemas.FINDINGS, jobs)
    return found if jobs is None else found.join(jobs.select("job_id").distinct(), "job_id", "left_semi")


def seen_jobs(spark: SparkSession, out: str, jobs: DataFrame | None = None) -> DataFrame:
    """The jobs of which files have arrived."""
    return read_bucketed(spark, out, "partials", _PARTIAL, jobs).select("job_id").distinct()


def close_jobs(
    spark, out: str, jobs: DataFrame, closing: int, opts: ScanOptions = ScanOptions(), secret: DataFrame | str = "",
    targets: tuple[str, ...] = ("slack",),
) -> None:
    """One summary, verdict, signed audit entry and set of notifications for each job that has not been closed.

    Every step writes the folder of its `closing` number, so one that runs again replaces what it wrote. Limits on
    findings count over the whole job. `completed_at` is the time of the job's last micro-batch.
    """
    wanted = jobs.select("job_id").distinct()
    wanted = wanted.join(seen_jobs(spark, out, wanted), "job_id", "left_semi")
    one = T.StructType([T.StructField("job_id", T.StringType())])
    before = read_bucketed(spark, out, "closed", one, wanted).where(F.col(BATCH) < closing)
    wanted = wanted.join(before, "job_id", "left_anti")
    write_batch(wanted, out, "closing", closing)
    closed = spark.read.schema(one).parquet(f"{out}/closing/{BATCH}={closing}")
    partial = read_bucketed(spark, out, "partials", _PARTIAL, closed).join(closed, "job_id", "left_semi")
    if opts.max_findings > 0:
        first = read_bucketed(spark, out, "first", schemas.FINDINGS, closed).drop(BATCH).join(closed, "job_id", "left_semi")
        counts = rollup.count_findings(rollup.cap_findings(first, opts.max_findings))
    else:
        counts = partial.where("n > 0").groupBy("job_id", "severity", "category").agg(F.sum("n").alias("n"))
    ends = partial.groupBy("job_id").agg(F.max("seen_at").alias("completed_at"))
    summary = rollup.gate(rollup.summarise_counts(counts, closed), opts.fail_on).join(ends, "job_id", "left")
    write_batch(summary, out, "summary", closing)
    done = spark.read.schema(summary.schema).parquet(f"{out}/summary/{BATCH}={closing}")
    write_batch(verdict_of(done), out, "verdict", closing)
    if isinstance(secret, DataFrame) or secret:
        write_batch(audit.audit_entries(audit.analysis_events(done), secret), out, "audit", closing)
    if targets:
        asked = done.withColumn("targets", F.array(*[F.lit(t) for t in targets]))
        write_batch(export.notifications(asked), out, "outbox", closing)
    write_bucketed(closed, out, "closed", closing)


def latest_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update mode, the last state of each key."""
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return last.select(*keys, "_row.*")


def stream_append(df: DataFrame, out: str, checkpoint: str, available_now: bool = False, mode: str = "append") -> StreamingQuery:
    """Any streaming relation as a Parquet table, batch by batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_audit(events: DataFrame, secret: DataFrame | str, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Signed entries appended exactly once by the file sink, one folder per day."""
    entries = audit.audit_entries(events, secret).withColumn("dt", F.to_date("created_at"))
    writer = (
        entries.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .partitionBy("dt").outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
