"""How severities are named and ordered by the consumers of findings. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftmark.schemas import SEVERITIES

WEIGHTS = {"critical": 20, "high": 10, "medium": 4, "low": 1}
BLOCKING = ["critical", "high"]
# fail_on -> severities that fail the gate; None stands for any finding at all
GATES = {
    "never": [], "critical": ["critical"], "high": ["critical", "high"],
    "medium": ["critical", "high", "medium"], "low": None,
}


def blocking(severity: Column) -> Column:
    return severity.isin(BLOCKING)


def workflow_level(severity: Column) -> Column:
    return F.when(blocking(severity), "error").when(severity == "info", "notice").otherwise("warning")


def sarif_level(severity: Column) -> Column:
    return F.when(blocking(severity), "error").when(severity.isin("low", "info"), "note").otherwise("warning")


def checkrun_level(severity: Column) -> Column:
    return F.when(blocking(severity), "failure").when(severity == "medium", "warning").otherwise("notice")


def severity_rank(severity: Column) -> Column:
    """1 for critical up to 5 for info, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
