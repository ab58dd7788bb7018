"""Webhook deliveries and manual requests become jobs; the rest is kept with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftmark import schemas
from siftmark.functions.signing import signing_key, stable_id, webhook_signature

# Fixed values of the webhook contract.
SCANNED_ACTIONS = ["opened", "synchronize", "reopened"]
SCANNED_EVENT = "pull_request"
MAX_BODY_BYTES = 10 << 20


def _owner_repo(full: Column) -> tuple[Column, Column]:
    """Split at the first slash; without one everything is the owner."""
    at = F.instr(full, "/")
    owner = F.when(at > 0, F.substring(full, F.lit(1), at - 1)).otherwise(full)
    return owner, F.when(at > 0, F.substring(full, at + 1, F.length(full))).otherwise("")


def _job_columns(**given: Column) -> list[Column]:
    out = []
    for f in schemas.JOBS:
        col = given.get(f.name, F.lit(None))
        out.append(col.cast(f.dataType).alias(f.name))
    return out


def classify_webhooks(raw: DataFrame, secret: DataFrame | str = "", max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Deliveries with `reason` (null for accepted ones) and the decoded `payload`.

    `raw` has body (binary or string), event, signature and received_at. Works on
    batch and streaming frames alike.
    """
    body = F.col("body").cast("binary")
    schema = schemas.WEBHOOK_BODY.simpleString()[len("struct<"):-1]
    decoded = F.from_json(
        F.col("body").cast("string"), f"struct<{schema},_bad:string>", {"columnNameOfCorruptRecord": "_bad"},
    )
    trusted = F.lit(True)
    if isinstance(secret, DataFrame) or secret:
        trusted = F.coalesce(webhook_signature(body, signing_key(raw.sparkSession, secret)) == F.col("signature"), F.lit(False))
    # a generator is not merged with the filters and projections behind it, so that each
    # body is signed and decoded once
    once = F.inline(F.array(F.struct(decoded.alias("payload"), trusted.alias("_trusted"))))
    return raw.select("*", once).withColumn(
        "reason",
        F.when(F.octet_length(body) > max_bytes, "body too large")
        .when(~F.col("_trusted"), "invalid signature")
        .when(~F.col("event").eqNullSafe(SCANNED_EVENT), "ignored event")
        .when(F.col("payload").isNull() | F.col("payload._bad").isNotNull(), "invalid payload")
        .when(~F.coalesce(F.col("payload.action"), F.lit("")).isin(SCANNED_ACTIONS), "ignored action"),
    ).drop("_trusted")


def ingest_webhooks(raw: DataFrame, secret: DataFrame | str = "", max_bytes: int = MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejects)."""
    seen = classify_webhooks(raw, secret, max_bytes)
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    head = "payload.pull_request.head"
    owner, repo = _owner_repo(text(f"{head}.repo.full_name"))
    jobs = seen.where("reason IS NULL").select(*_job_columns(
        id=stable_id(F.lit("github"), F.col("body"), F.col("received_at")), source=F.lit("github"),
        repo_url=text(f"{head}.repo.clone_url"), repo_owner=owner, repo_name=repo,
        commit_sha=text(f"{head}.sha"), branch=text(f"{head}.ref"),
        pr_number=F.coalesce(F.col("payload.number"), F.lit(0)), status=F.lit("queued"),
        created_at=F.col("received_at"),
    ))
    return jobs, seen.where("reason IS NOT NULL").drop("payload")


def ingest_manual_jobs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejects) from requests with repo_url, commit_sha, branch and created_at."""
    filled = (F.coalesce("repo_url", F.lit("")) != "") & (F.coalesce("commit_sha", F.lit("")) != "")
    jobs = requests.where(filled).select(*_job_columns(
        id=stable_id(F.lit("manual"), F.col("repo_url"), F.col("commit_sha"), F.col("branch"), F.col("created_at")),
        source=F.lit("manual"), repo_url=F.col("repo_url"), repo_owner=F.lit(""), repo_name=F.lit(""),
        commit_sha=F.col("commit_sha"), branch=F.coalesce("branch", F.lit("")), pr_number=F.lit(0),
        status=F.lit("queued"), created_at=F.coalesce("created_at", F.current_timestamp()),
    ))
    rejects = requests.where(~filled).withColumn("reason", F.lit("repo_url and commit_sha required"))
    return jobs, rejects
