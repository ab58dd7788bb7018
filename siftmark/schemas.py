"""Explicit schemas of every relation. Nothing in the library infers a schema."""

from pyspark.sql import types as T

SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["security", "quality", "license", "compliance", "style"]
JOB_STATUSES = ["queued", "running", "completed", "failed", "cancelled"]
JOB_SOURCES = ["github", "gitlab", "azure_devops", "manual"]


def _fields(*pairs):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
_STRINGS = T.ArrayType(_S)

FILES = _fields(("job_id", _S), ("path", _S), ("language", _S), ("content", _S))

RULES = _fields(
    ("rule_seq", _I), ("rule_id", _S), ("name", _S), ("description", _S), ("category", _S),
    ("severity", _S), ("languages", _STRINGS),
    ("pattern", _fields(("type", _S), ("match", _S), ("max", _I), ("negate", _B))),
    ("message", _S), ("fix", _S), ("enabled", _B),
    ("tests", _fields(("pass", _STRINGS), ("fail", _STRINGS))),
    ("supported", _B),
)

# phase, rule_seq and match_idx complete the order of findings inside a job.
FINDINGS = _fields(
    ("job_id", _S), ("rule_id", _S), ("rule_name", _S), ("category", _S), ("severity", _S),
    ("file", _S), ("line", _I), ("column", _I), ("message", _S), ("snippet", _S),
    ("fix_suggestion", _S), ("phase", _I), ("rule_seq", _I), ("match_idx", _I),
)

JOBS = _fields(
    ("id", _S), ("source", _S), ("repo_url", _S), ("repo_owner", _S), ("repo_name", _S),
    ("commit_sha", _S), ("branch", _S), ("pr_number", _I), ("status", _S), ("created_at", _TS),
    ("started_at", _TS), ("completed_at", _TS), ("meta", T.MapType(_S, _S)),
)

JOB_EVENTS = _fields(("job_id", _S), ("type", _S), ("payload", _S), ("at", _TS))

AUDIT = _fields(
    ("id", _S), ("job_id", _S), ("event_type", _S), ("actor", _S), ("payload", _S),
    ("signature", _S), ("created_at", _TS),
)

WEBHOOK_BODY = _fields(
    ("action", _S), ("number", _I),
    ("pull_request", _fields(("head", _fields(
        ("sha", _S), ("ref", _S), ("repo", _fields(("clone_url", _S), ("full_name", _S))),
    )))),
)

MANUAL_REQUESTS = _fields(
    ("repo_url", _S), ("commit_sha", _S), ("branch", _S), ("created_at", _TS),
)

SAMPLES = _fields(
    ("service", _S), ("metric", _S), ("kind", _S), ("le", _S), ("ts", _TS), ("value", _D),
)

DEPS = _fields(("job_id", _S), ("path", _S), ("ecosystem", _S), ("name", _S), ("version", _S))
