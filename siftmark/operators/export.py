"""Findings and results as documents for other tools.

Line forms (annotations, SARIF results, text lines) are one row per finding and
are written as text or JSON lines. Documents and check runs come in parts, numbered
from 0, of `per_part` findings in finding order; a job without findings has one part
without rows. Comment, chat and mail are short and say how many findings they leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftmark.functions.levels import checkrun_level, sarif_level, workflow_level
from siftmark.operators.rollup import cap_findings, collect_part, finding_parts
from siftmark.schemas import SEVERITIES
from siftmark.sources.rules import Rule

TOOL = "siftmark"
VERSION = "0.1.0"
# Fixed values of the formats.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
CHECKRUN_ANNOTATIONS = 50
COMMENT_FINDINGS = 10
COLOURS = {True: "#2e7d32", False: "#c62828"}
_STATE = {True: "clean", False: "blocked"}


def _fmt(template: str, *cols) -> Column:
    return F.format_string(template, *[F.col(c) if isinstance(c, str) else c for c in cols])


def _title() -> Column:
    return _fmt("[%s] %s", "rule_id", "rule_name")


def _passed(yes, no) -> Column:
    return F.when(F.col("passed"), yes).otherwise(no)


def _omit_empty(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one line per finding."""
    text = _fmt(
        "::%s file=%s,line=%d,col=%d,title=%s::%s",
        workflow_level(F.col("severity")), "file", "line", "column", _title(), "message",
    )
    return findings.select("job_id", "file", "line", "rule_id", "phase", "rule_seq", "match_idx", text.alias("text"))


def _finding_json() -> dict[str, Column]:
    plain = ["rule_id", "rule_name", "category", "severity", "file", "line", "column", "message"]
    out = {c: F.col(c) for c in plain}
    return {**out, "snippet": _omit_empty("snippet"), "fix_suggestion": _omit_empty("fix_suggestion")}


def finding_json_lines(findings: DataFrame) -> DataFrame:
    row = F.struct(*[c.alias(n) for n, c in _finding_json().items()])
    return findings.select("job_id", F.to_json(row).alias("json"))


def _documents(findings: DataFrame, jobs: DataFrame, row: dict[str, Column], per_part: int) -> DataFrame:
    """jobs with `part` and `rows`; a job without findings has one part without rows."""
    packed = finding_parts(findings, per_part).groupBy("job_id", "part").agg(collect_part(row).alias("rows"))
    out = jobs.join(packed, "job_id", "left")
    empty = F.array().cast(packed.schema["rows"].dataType)
    return out.withColumns({"rows": F.coalesce("rows", empty), "part": F.coalesce("part", F.lit(0).cast("long"))})


def json_results(findings: DataFrame, summary: DataFrame, per_part: int = 5000) -> DataFrame:
    """(job_id, part, json): findings and summary of a job."""
    docs = _documents(findings, summary, _finding_json(), per_part)
    names = ["total_findings", "by_severity", "by_category", "score", "passed"]
    extra = [c for c in ("repo_owner", "repo_name", "commit_sha", "language", "completed_at", "duration_ms") if c in summary.columns]
    doc = F.struct(
        "job_id", *extra, F.col("rows").alias("findings"), F.struct(*names).alias("summary"),
    )
    return docs.select("job_id", "part", F.to_json(doc).alias("json"))


def _sarif_row() -> dict[str, Column]:
    place = F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region"),
    ).alias("physicalLocation"))
    return {
        "ruleId": F.col("rule_id"), "level": sarif_level(F.col("severity")),
        "message": F.struct(F.col("message").alias("text")), "locations": F.array(place),
    }


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF result objects, one per finding."""
    row = F.struct(*[c.alias(n) for n, c in _sarif_row().items()])
    return findings.select("job_id", "file", "line", "rule_id", F.to_json(row).alias("json"))


def sarif_documents(findings: DataFrame, jobs: DataFrame, rules: list[Rule], per_part: int = 5000) -> DataFrame:
    """(job_id, part, json): SARIF documents that list all loaded rules."""
    listed = F.array(*[
        F.struct(F.lit(r.rule_id).alias("id"), F.lit(r.name).alias("name"),
                 F.struct(F.lit(r.message).alias("text")).alias("shortDescription"))
        for r in rules
    ]) if rules else F.array().cast("array<struct<id:string>>")
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), listed.alias("rules"))
    docs = _documents(findings, jobs.select("job_id").distinct(), _sarif_row(), per_part)
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("rows").alias("results"))
    doc = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"),
    )
    return docs.select("job_id", "part", F.to_json(doc).alias("json"))


def text_line() -> Column:
    head = _fmt("%s:%d:%d %s %s (%s)", "file", "line", "column", "severity", "message", "rule_id")
    return F.when(F.col("snippet") != "", F.concat(head, F.lit("\n    > "), "snippet")).otherwise(head)


def text_lines(findings: DataFrame) -> DataFrame:
    return findings.select(
        "job_id", "file", "line", "phase", "rule_seq", "match_idx", text_line().alias("text")
    )


def _tallies(sep: str) -> Column:
    """critical 1, low 3: the severities that occur."""
    counts = [F.when(F.col(f"n_{s}") > 0, _fmt(f"{s} %d", f"n_{s}")) for s in SEVERITIES]
    return F.concat_ws(sep, *counts)


def text_head(summary: DataFrame) -> DataFrame:
    """(job_id, text): the report above the list of findings."""
    found = F.when(F.col("total_findings") == 0, "nothing found").otherwise(
        F.concat(_fmt("%d findings: ", "total_findings"), _tallies(", "))
    )
    text = F.concat(_fmt(f"{TOOL} report for %s: %s, %.0f of 100 points\n", "job_id", _passed(_STATE[True], _STATE[False]), "score"), found)
    return summary.select("job_id", text.alias("text"))


def text_reports(findings: DataFrame, summary: DataFrame, per_part: int = 5000) -> DataFrame:
    """(job_id, part, text): head and findings; further parts of a job go on without head."""
    docs = _documents(findings, text_head(summary), {"line": text_line()}, per_part)
    lines = F.concat_ws("\n", F.transform("rows", lambda r: r["line"]))
    text = F.when(F.col("part") > 0, lines).when(F.size("rows") > 0, F.concat_ws("\n", "text", lines)).otherwise(F.col("text"))
    return docs.select("job_id", "part", text.alias("text"))


def _run_columns(results: DataFrame) -> DataFrame:
    """Results with the repository, commit and time columns filled in where absent."""
    fill = {"repo_owner": "''", "repo_name": "''", "commit_sha": "''", "duration_ms": "0L", "completed_at": "CAST(NULL AS timestamp)"}
    missing = {c: F.expr(e) for c, e in fill.items() if c not in results.columns}
    return results.withColumns(missing) if missing else results


def checkrun_payloads(findings: DataFrame, results: DataFrame, per_part: int = CHECKRUN_ANNOTATIONS) -> DataFrame:
    """(job_id, part, json) of a check run; `results` is the summary with job columns.

    A request takes 50 annotations at most, so part 0 opens the run and the others add to it.
    """
    line = F.greatest(F.lit(1), F.col("line"))
    note = {
        "path": F.col("file"), "start_line": line, "end_line": line, "annotation_level": checkrun_level(F.col("severity")),
        "message": F.col("message"), "title": _title(),
    }
    r = _documents(findings, _run_columns(results), note, per_part)
    title = F.concat(_passed("Nothing blocks", "Findings block"), _fmt(", %.0f of 100 points", "score"))
    told = F.concat(_fmt("%d findings in %d ms. ", "total_findings", "duration_ms"), _tallies(", "))
    output = F.struct(title.alias("title"), told.alias("summary"), F.col("rows").alias("annotations"))
    doc = F.struct(
        F.lit(TOOL).alias("name"), F.col("commit_sha").alias("head_sha"), F.lit("completed").alias("status"),
        _passed("success", "failure").alias("conclusion"),
        F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at"), output.alias("output"),
    )
    return r.select("job_id", "part", F.to_json(doc).alias("json"))


def pr_comments(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, body): a short summary in markdown."""
    item = _fmt("1. %s, line %d: %s (%s)\n", "file", "line", "message", "rule_id")
    first = cap_findings(findings, COMMENT_FINDINGS).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items")
    )
    r = _run_columns(results).join(first, "job_id", "left")
    more = F.col("total_findings") - COMMENT_FINDINGS
    listed = F.concat(
        F.lit("\n\n"), _tallies(", "), F.lit("\n\n"), F.array_join(F.transform("items", lambda i: i["item"]), ""),
        F.when(more > 0, _fmt("\n%d more are in the full report.\n", more)).otherwise(""),
    )
    head = _fmt(f"### {TOOL}: %s\n%.0f of 100 points at %s", _passed(_STATE[True], _STATE[False]), "score", F.left(F.col("commit_sha"), F.lit(8)))
    return r.select("job_id", F.concat(head, F.when(F.col("total_findings") > 0, listed).otherwise("")).alias("body"))


def chat_messages(results: DataFrame) -> DataFrame:
    """(job_id, json): an attachment with a colour and one line."""
    r = _run_columns(results)
    text = F.concat(
        _fmt("%s/%s is %s with %.0f of 100 points", "repo_owner", "repo_name", _passed(_STATE[True], _STATE[False]), "score"),
        F.when(F.col("total_findings") > 0, F.concat(F.lit("; "), _tallies(", "))).otherwise(""),
    )
    note = F.struct(
        _passed(COLOURS[True], COLOURS[False]).alias("color"), text.alias("text"), F.lit(TOOL).alias("footer"),
        F.unix_timestamp("completed_at").alias("ts"), F.array(F.lit("text")).alias("mrkdwn_in"),
    )
    return r.select("job_id", F.to_json(F.struct(F.array(note).alias("attachments"))).alias("json"))


def mail_messages(results: DataFrame) -> DataFrame:
    """(job_id, subject, body)."""
    r = _run_columns(results)
    subject = _fmt(f"%s/%s is %s ({TOOL})", "repo_owner", "repo_name", _passed(_STATE[True], _STATE[False]))
    body = F.concat(
        _fmt("The scan of %s at %s took %d ms and gives %.0f of 100 points.\n", F.concat_ws("/", "repo_owner", "repo_name"), "commit_sha", "duration_ms", "score"),
        F.when(F.col("total_findings") > 0, F.concat(_fmt("It has %d findings:\n", "total_findings"), _tallies("\n"), F.lit("\n"))).otherwise(""),
    )
    return r.select("job_id", subject.alias("subject"), body.alias("body"))


def notifications(results: DataFrame) -> DataFrame:
    """The outbox: one row per (job, target of `targets`). Chat has a body; mail has no recipients
    configured, so it is only noted; an unknown target gives no row."""
    chat = chat_messages(results)
    asked = results.select("job_id", F.explode(F.array_distinct("targets")).alias("target")).where(
        F.col("target").isin("slack", "email")
    )
    state = F.when(F.col("target") == "slack", "ready").otherwise("no recipients configured")
    return asked.join(chat, "job_id").select(
        "job_id", "target", state.alias("state"), F.when(F.col("target") == "slack", F.col("json")).alias("body"),
    )


def exposition(samples: DataFrame) -> DataFrame:
    """Metric text lines of samples(service, metric, kind, le, value), with a TYPE line per metric.

    A histogram sample is named <metric>_bucket, <metric>_sum or <metric>_count.
    """
    name = F.concat("service", F.lit("_"), "metric")
    family = F.regexp_replace("metric", "_(bucket|sum|count)$", "")
    base = F.when(F.col("kind") == "histogram", F.concat("service", F.lit("_"), family)).otherwise(name)
    whole = F.format_string("%d", F.col("value").cast("long"))
    shown = F.when((F.col("kind") == "histogram") & F.col("metric").endswith("_sum"), F.format_string("%.3f", "value")).otherwise(whole)
    label = F.when(F.col("le").isNotNull(), F.format_string('{le="%s"}', "le")).otherwise("")
    bound = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double"))
    place = F.when(F.col("metric").endswith("_bucket"), 1).when(F.col("metric").endswith("_sum"), 2).otherwise(3)
    lines = samples.select(
        "service", base.alias("family"), place.alias("place"), bound.alias("bound"),
        F.concat(name, label, F.lit(" "), shown).alias("text"), "kind",
    )
    heads = lines.groupBy("service", "family", "kind").agg(F.lit(0).alias("place")).select(
        "service", "family", "place", F.lit(None).cast("double").alias("bound"),
        F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind").alias("text"),
    )
    return lines.drop("kind").unionByName(heads)
