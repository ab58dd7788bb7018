"""Append-only, signed audit log: write, filter, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftmark.functions.signing import hmac_hex, signature_valid, signing_key, stable_id, webhook_signature
from siftmark.functions.text import truncate_bytes

AUDIT_COLUMNS = ["id", "job_id", "event_type", "actor", "payload", "signature", "created_at"]
DEFAULT_LIMIT = 50  # fixed value


def _is_string(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant")) == "STRING"


def audit_entries(events: DataFrame, secret: DataFrame | str, sign_columns: tuple[str, ...] = ("payload",)) -> DataFrame:
    """Entries from events with a JSON `payload` and `created_at`.

    job_id, event_type and actor are lifted from the payload, '' unless they are
    strings. An entry that has a signature keeps it. The id is derived from the
    event, so a task that runs twice writes the same entry; events that may repeat
    an equal payload at one instant bring their own `id`.
    """
    missing = [n for n in ("job_id", "event_type", "actor") if n not in events.columns]
    out = events
    if missing:
        # parsed once per entry: a generator is not merged with the projection behind it
        parsed = F.inline(F.array(F.struct(F.try_parse_json("payload").alias("_doc"))))
        lifted = {n: F.when(_is_string(n), F.try_variant_get("_doc", f"$.{n}", "string")) for n in missing}
        out = events.select("*", parsed).withColumns({n: F.coalesce(c, F.lit("")) for n, c in lifted.items()}).drop("_doc")
    if "id" not in events.columns:
        out = out.withColumn("id", stable_id(F.col("payload"), F.col("created_at")))
    # several columns are signed as JSON with their nulls, so that no two rows look alike
    signed = F.to_json(F.struct(*sign_columns), {"ignoreNullFields": "false"}) if len(sign_columns) > 1 else F.col(sign_columns[0])
    signature = hmac_hex(signed, signing_key(events.sparkSession, secret))
    if "signature" in events.columns:
        signature = F.coalesce(F.nullif(F.col("signature"), F.lit("")), signature)
    return out.withColumn("signature", signature).select(AUDIT_COLUMNS)


def append_audit(events: DataFrame, secret: DataFrame | str, path: str, batch: str) -> None:
    """Sign and append, one folder per batch and day of created_at; a batch that runs again replaces its folder."""
    entries = audit_entries(events, secret).withColumn("dt", F.to_date("created_at"))
    entries.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch={batch}")


def filter_audit(
    entries: DataFrame, job_id: str = "", event_type: str = "", actor: str = "", since=None, until=None,
) -> DataFrame:
    """Only the given filters count; both time bounds are inclusive and also prune day folders."""
    out = entries
    for name, value in (("job_id", job_id), ("event_type", event_type), ("actor", actor)):
        if value:
            out = out.where(F.col(name) == value)
    by_day = "dt" in entries.columns
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
        out = out.where(F.col("dt") >= F.to_date(F.lit(since))) if by_day else out
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until))
        out = out.where(F.col("dt") <= F.to_date(F.lit(until))) if by_day else out
    return out


def query_audit(entries: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters) -> DataFrame:
    """A page of the filtered log, newest first; ties by id. limit 0 means all rows."""
    out = filter_audit(entries, **filters).orderBy(F.desc("created_at"), F.col("id"))
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit > 0 else out


def list_audit(entries: DataFrame, id_bytes: int = 32, job_bytes: int = 24) -> DataFrame:
    """(id, job_id, event_type, actor, text): what a listing shows, long ids cut to that many bytes; `text` is the
    row in columns of fixed width."""
    shown = entries.select(
        truncate_bytes(F.col("id"), id_bytes).alias("id"), truncate_bytes(F.col("job_id"), job_bytes).alias("job_id"), "event_type", "actor",
    )
    pad = lambda name, width: F.when(F.length(name) < width, F.rpad(name, width, " ")).otherwise(F.col(name))
    return shown.withColumn("text", F.concat_ws("  ", pad("id", id_bytes), pad("job_id", job_bytes), pad("event_type", 20), F.col("actor")))


def verify_audit(entries: DataFrame, secret: DataFrame | str, ids: DataFrame | None = None) -> DataFrame:
    """(id, valid) for every entry, or for the asked ids; an unknown id is not valid."""
    key = signing_key(entries.sparkSession, secret)
    checked = entries.select("id", signature_valid(F.col("payload"), F.col("signature"), key).alias("valid"))
    if ids is None:
        return checked
    asked = ids.select("id").distinct()
    return asked.join(checked, "id", "left").select("id", F.coalesce("valid", F.lit(False)).alias("valid"))


def verification_counts(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count(F.lit(1)).alias("verified"), F.count_if(~F.col("valid")).alias("failed"))


def verify_webhooks(raw: DataFrame, secret: DataFrame | str) -> DataFrame:
    """Deliveries with `valid`, over the raw body and the signature header."""
    expected = webhook_signature(F.col("body").cast("binary"), signing_key(raw.sparkSession, secret))
    return raw.withColumn("valid", F.coalesce(expected == F.col("signature"), F.lit(False)))


def analysis_events(results: DataFrame) -> DataFrame:
    """The event a finished analysis leaves in the log; `results` has job_id, completed_at and result columns."""
    result = F.struct(*[F.col(c) for c in results.columns])
    payload = F.to_json(F.struct(
        F.lit("analysis-service").alias("actor"), F.lit("analysis_complete").alias("event_type"),
        F.col("job_id").alias("job_id"), result.alias("result"),
    ))
    return results.select(payload.alias("payload"), F.col("completed_at").alias("created_at"))
