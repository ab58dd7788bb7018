"""Findings to counts, scores, verdicts, gates and capped lists.

Every per-job result is a partial aggregate over scalars, so a job that holds a
third of all findings costs its reducer a handful of rows. Lists of findings stay
rows; nested forms are cut into parts (`finding_parts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmark.functions.levels import BLOCKING, GATES, WEIGHTS, blocking, severity_rank
from siftmark.operators.scan import finding_order
from siftmark.plans.shared import materialise, numbered
from siftmark.schemas import SEVERITIES

_COUNTS = [f"n_{s}" for s in SEVERITIES]


def summarise(findings: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per job: total, n_<severity>, maps by severity and category, score, passed.

    With `jobs` (a frame with job_id) jobs without findings are there too.
    """
    return summarise_counts(count_findings(findings), jobs)


def count_findings(findings: DataFrame) -> DataFrame:
    """(job_id, severity, category, n); counts of parts of a job can be added up."""
    return findings.groupBy("job_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"))


def summarise_counts(parts: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """`summarise` from (job_id, severity, category, n), one row for each of the three."""
    # at most one row per severity and category of the packs is collected per job
    per_job = parts.groupBy("job_id").agg(
        F.sum("n").alias("total_findings"),
        *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(c) for s, c in zip(SEVERITIES, _COUNTS)],
        F.collect_list(F.struct("severity", "category", "n")).alias("cells"),
    )
    if jobs is not None:
        per_job = jobs.select("job_id").distinct().join(per_job, "job_id", "left").fillna(
            0, ["total_findings", *_COUNTS]
        )
    summed = per_job.select(
        "job_id", "total_findings", *_COUNTS,
        _tally("severity").alias("by_severity"), _tally("category").alias("by_category"),
    )
    return summed.withColumn("score", score()).withColumn("passed", _count(BLOCKING) == 0)


def _tally(key: str) -> Column:
    cells = F.coalesce(F.col("cells"), F.array().cast("array<struct<severity:string,category:string,n:bigint>>"))
    keys = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c[key])))

    def entry(k):
        own = F.filter(cells, lambda c: c[key] == k)
        return F.struct(k.alias("key"), F.aggregate(own, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("value"))

    return F.map_from_entries(F.transform(keys, entry))


def _count(severities: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for s in severities:
        total = total + F.col(f"n_{s}")
    return total


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    """100 minus the weighted counts, never below 0."""
    lost = F.lit(0.0)
    for severity, w in weights.items():
        lost = lost + F.col(f"n_{severity}") * F.lit(float(w))
    return F.greatest(F.lit(0.0), F.lit(100.0) - lost)


def gate(summary: DataFrame, fail_on: str = "high") -> DataFrame:
    """`exit_code` 1 for jobs that reach the level; an unknown level fails nothing."""
    levels = GATES.get(fail_on or "high", [])
    failing = F.col("total_findings") if levels is None else _count(levels)
    return summary.withColumn("fail_on", F.lit(fail_on)).withColumn("exit_code", (failing > 0).cast("int"))


def verdict_text() -> Column:
    return F.concat(F.lit("["), "rule_id", F.lit("] "), "message", F.lit(" at "), "file", F.lit(":"), F.col("line").cast("string"))


def policy_messages(findings: DataFrame) -> DataFrame:
    """One row per finding: error or warning, its text and the matched rule, in finding order columns."""
    return findings.select(
        "job_id", F.when(blocking(F.col("severity")), "error").otherwise("warning").alias("kind"),
        verdict_text().alias("text"), "rule_id", F.lit(True).alias("matched"), F.col("message").alias("reason"),
        "file", "line", "phase", "rule_seq", "match_idx",
    )


def policy_verdict(findings: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per job: allowed, blocked and the number of errors and warnings.

    The texts are rows of `policy_messages`; `nested_verdict` packs them.
    """
    hard = blocking(F.col("severity"))
    out = findings.groupBy("job_id").agg(
        F.count_if(hard).alias("n_errors"), F.count_if(~hard).alias("n_warnings"),
    )
    if jobs is not None:
        out = jobs.select("job_id").distinct().join(out, "job_id", "left").fillna(0, ["n_errors", "n_warnings"])
    blocked = F.col("n_errors") > 0
    return out.select("job_id", (~blocked).alias("allowed"), blocked.alias("blocked"), "n_errors", "n_warnings")


def number_findings(findings: DataFrame) -> DataFrame:
    """Adds `number`: the place of a finding in its job, from 1, in finding order.

    The findings are written first, as dealing rows by ranges reads them twice and would scan twice."""
    return numbered(materialise(findings, "found"), "findings", ["job_id"], finding_order(), "number")


def finding_parts(findings: DataFrame, per_part: int = 5000) -> DataFrame:
    """Adds `part`, from 0: the first `per_part` findings of a job in finding order, the next, and so on.

    The rule is the same for every job; no task sorts or holds a whole job. The numbered findings are written to
    a table while the query is built.
    """
    part = F.floor((F.col("number") - 1) / F.lit(per_part)).cast("long")
    return number_findings(findings).withColumn("part", part).drop("number")


def collect_part(columns: dict[str, Column]) -> Column:
    """Aggregate: the structs of one part in finding order."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(finding_order())])
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def nested_verdict(findings: DataFrame, per_part: int = 5000) -> DataFrame:
    """errors, warnings and rules as arrays, one row per job and part."""
    row = {
        "hard": blocking(F.col("severity")), "text": verdict_text(),
        "rule_id": F.col("rule_id"), "matched": F.lit(True), "reason": F.col("message"),
    }
    packed = finding_parts(findings, per_part).groupBy("job_id", "part").agg(collect_part(row).alias("rows"))
    texts = lambda hard: F.transform(F.filter("rows", lambda r: r["hard"] == hard), lambda r: r["text"])
    return packed.select(
        "job_id", "part", texts(F.lit(True)).alias("errors"), texts(F.lit(False)).alias("warnings"),
        F.transform("rows", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["matched"].alias("matched"), r["reason"].alias("reason"))).alias("rules"),
    )


def cap_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of each job in finding order, with their `rank`; n <= 0 keeps all.

    Spark cuts every task's rows to n before the shuffle (window group limit) as long as n does not
    exceed that limit's threshold; for more, findings are numbered by ranges, which writes them to a table
    while the query is built.
    """
    if n <= 0:
        return findings
    if n > int(findings.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        found = number_findings(findings).withColumnRenamed("number", "rank").where(F.col("rank") <= n)
    else:
        rank = F.row_number().over(Window.partitionBy("job_id").orderBy(*finding_order()))
        found = findings.withColumn("rank", rank).where(F.col("rank") <= n)
    return found.withColumn("rank", F.col("rank").cast("int"))


def job_report(summary: DataFrame, findings: DataFrame, jobs: DataFrame | None = None, top: int = 15) -> DataFrame:
    """One row per job: summary, its first findings as text and how many more there are."""
    line = F.concat(F.lit("["), "rule_id", F.lit("] "), "file", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "message")
    first = cap_findings(findings, top).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("text")))).alias("rows")
    )
    out = summary.join(first, "job_id", "left")
    if jobs is not None:
        out = out.join(jobs, "job_id", "left")
    texts = F.transform(F.coalesce("rows", F.array().cast("array<struct<rank:int,text:string>>")), lambda r: r["text"])
    more = F.greatest(F.col("total_findings") - top, F.lit(0).cast("long"))
    return out.withColumn("top_findings", texts).withColumn("more", more).drop("rows")


def job_list(summary: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a listing of jobs shows: id, repository, score and result."""
    repo = F.concat_ws("/", F.coalesce("repo_owner", F.lit("")), F.coalesce("repo_name", F.lit("")))
    return jobs.join(summary, "job_id").select("job_id", repo.alias("repo"), "score", "passed")


def finding_groups(findings: DataFrame, *keys: str, top: int = 0) -> DataFrame:
    """Findings counted by any columns over the whole corpus, the most frequent first."""
    out = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"), F.min("job_id").alias("first_job"),
    ).orderBy(F.desc("findings"), *keys)
    return out.limit(top) if top > 0 else out


def severity_totals(findings: DataFrame) -> DataFrame:
    """Counts per severity, from critical to info, anything else at the end."""
    rank = severity_rank(F.col("severity"))
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    return counted.withColumn("rank", F.when(rank > 0, rank).otherwise(len(SEVERITIES) + 1)).orderBy("rank", "severity")


def finding_cube(findings: DataFrame) -> DataFrame:
    """Counts by category, by severity, by both and overall; findings are counted before the cube
    multiplies rows."""
    cells = findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    return cells.cube("category", "severity").agg(F.sum("n").alias("findings"))
