"""The whole scan as one job: findings, summary, gate and verdict of every job at once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftmark import schemas
from siftmark.operators import rollup
from siftmark.operators.scan import DEALT, LISTED, PHASE_LISTED, ScanOptions, scan_files
from siftmark.plans.shared import materialise
from siftmark.sources.files import exclude_prefixes
from siftmark.sources.rules import Rule


@dataclass
class ScanResult:
    findings: DataFrame
    summary: DataFrame
    verdict: DataFrame


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Split an input that has fewer partitions than the cluster has cores, by the keys of its
    rows (of files: job and path).

    A scan is costly per byte, so an input of a few large splits is worth one shuffle.
    Inputs with enough splits, the rule at scale, are left as they are. Only for inputs
    read straight from storage: counting the splits behind a shuffle would run it.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *(keys or ("job_id", "path"))) if df.rdd.getNumPartitions() < tasks else df


def scan_corpus(files: DataFrame, rules: list[Rule], opts: ScanOptions = ScanOptions()) -> ScanResult:
    """Lazy form. Whoever uses more than one of the results should take `run_scan`,
    which computes the findings once."""
    kept = exclude_prefixes(files, list(opts.exclude))
    return _roll_up(kept, _find(kept, rules, opts), opts)


def _find(files: DataFrame, rules: list[Rule], opts: ScanOptions) -> DataFrame:
    files = spread(files) if opts.spread else files
    return rollup.cap_findings(scan_files(files, rules, opts), opts.max_findings).drop("rank")


def _store_findings(files: DataFrame, rules: list[Rule], opts: ScanOptions, path: str) -> DataFrame:
    """The same as a table, with long texts dealt over the tasks: one pass scans the others and lists the long ones,
    which alone are read again."""
    read = spread(files) if opts.spread else files
    found = scan_files(read, rules, replace(opts, long_texts=LISTED))

    def write(df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(found.schema).parquet(path)

    stored = materialise(found, "scanned") if opts.max_findings > 0 else write(found)
    long = stored.where(F.col("phase") == PHASE_LISTED).select("job_id", F.col("file").alias("path")).distinct()
    if not long.isEmpty():
        named = materialise(long.select(F.col("job_id").alias("_job"), F.col("path").alias("_path")), "long-texts")
        same = F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("path") == F.col("_path"))
        texts = files.where(F.octet_length("content") > opts.long_text).join(named, same, "left_semi")
        dealt = scan_files(texts, rules, replace(opts, long_texts=DEALT))
        stored = materialise(stored.where(F.col("phase") != PHASE_LISTED).unionByName(dealt), "scanned")
    elif opts.max_findings <= 0:
        return stored
    return write(rollup.cap_findings(stored, opts.max_findings).drop("rank"))


def _roll_up(files: DataFrame, findings: DataFrame, opts: ScanOptions) -> ScanResult:
    jobs = files.select("job_id").distinct()
    summary = rollup.gate(rollup.summarise(findings, jobs), opts.fail_on)
    return ScanResult(findings, summary, verdict_of(summary))


def verdict_of(summary: DataFrame) -> DataFrame:
    """The verdict follows from the counts, so it needs no second pass over the findings."""
    hard = F.col("n_critical") + F.col("n_high")
    return summary.select(
        "job_id", (hard == 0).alias("allowed"), (hard > 0).alias("blocked"),
        hard.alias("n_errors"), (F.col("total_findings") - hard).alias("n_warnings"),
    )


def run_scan(
    spark: SparkSession, files: DataFrame, rules: list[Rule], out: str, opts: ScanOptions = ScanOptions(),
) -> ScanResult:
    """Scan once into `out`/findings and roll up from that table into `out`/summary.

    The stored findings also cut the lineage: a lost executor repeats a read of
    them, not the scan. Texts above `opts.long_text` bytes are cut into ranges and dealt over all tasks.
    """
    kept = exclude_prefixes(files, list(opts.exclude))
    findings = _store_findings(kept, rules, opts, f"{out}/findings")
    result = _roll_up(kept, findings, opts)
    result.summary.write.mode("overwrite").parquet(f"{out}/summary")
    summary = spark.read.schema(result.summary.schema).parquet(f"{out}/summary")
    return ScanResult(findings, summary, verdict_of(summary))


_HISTORY = {
    "findings": schemas.FINDINGS,
    "summary": T.StructType([
        T.StructField("job_id", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("total_findings", *(f"n_{s}" for s in schemas.SEVERITIES))],
        T.StructField("by_severity", T.MapType(T.StringType(), T.LongType())), T.StructField("by_category", T.MapType(T.StringType(), T.LongType())),
        T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()),
        T.StructField("fail_on", T.StringType()), T.StructField("exit_code", T.IntegerType()),
    ]),
}


def append_scan(
    spark: SparkSession, files: DataFrame, rules: list[Rule], out: str, day: date, scan_id: str, opts: ScanOptions = ScanOptions(),
) -> ScanResult:
    """A scan into tables that hold many: `out`/findings and `out`/summary, by day and scan.

    A scan that runs again replaces its own folder and no other, also when it finds less than before.
    """
    if not scan_id or any(c in scan_id for c in "/=%"):
        raise ValueError("a scan id is a name without /, = and %")
    place = f"day={day.isoformat()}/scan_id={scan_id}"
    kept = exclude_prefixes(files, list(opts.exclude))
    findings = _store_findings(kept, rules, opts, f"{out}/findings/{place}")
    summary = _roll_up(kept, findings, opts).summary.select(*_HISTORY["summary"].names)
    summary.write.mode("overwrite").parquet(f"{out}/summary/{place}")
    summary = spark.read.schema(_HISTORY["summary"]).parquet(f"{out}/summary/{place}")
    return ScanResult(findings, summary, verdict_of(summary))


def read_scans(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The findings or the summary of all scans in `out`, with `day` and `scan_id`; filters on the two prune folders."""
    placed = T.StructType([*_HISTORY[name].fields, T.StructField("day", T.DateType()), T.StructField("scan_id", T.StringType())])
    return spark.read.schema(placed).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")
