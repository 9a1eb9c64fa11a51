"""States of runs, units, attempts, artifacts and deletion targets, and the moves between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of states and the allowed moves between them.
RUN_STATES = ("CREATED", "QUEUED", "PLANNING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
UNIT_STATES = ("PENDING", "READY", "SUBMITTING", "RUNNING", "RETRY_WAIT", "SUCCEEDED", "FAILED", "CANCELLED", "UNKNOWN")
ATTEMPT_STATES = ("PENDING", "SUBMITTING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED", "UNKNOWN")
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")
ARTIFACT_STATES = ("STAGING", "COMMITTED", "ABORTED")
ADMISSION_STATES = ("WAITING", "ADMITTED", "RELEASED")
TARGET_STATES = ("PENDING", "BLOCKED", "FAILED", "DELETED")
TARGET_KINDS = ("STAGING", "COMMITTED")
RESERVED_UNIT_STATES = ("READY", "SUBMITTING", "RUNNING", "RETRY_WAIT", "UNKNOWN")
RECOVERABLE_UNIT_STATES = ("SUBMITTING", "RUNNING", "RETRY_WAIT", "UNKNOWN")
WAITING_UNIT_STATES = ("PENDING", "READY", "RETRY_WAIT")
MOVES = {
    "run": {
        "CREATED": ("QUEUED", "CANCELLED"),
        "QUEUED": ("PLANNING", "CANCELLED"),
        "PLANNING": ("RUNNING", "FAILED", "CANCELLED"),
        "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED"),
    },
    "unit": {
        "PENDING": ("READY", "CANCELLED"),
        "READY": ("SUBMITTING", "CANCELLED"),
        "SUBMITTING": ("RUNNING", "RETRY_WAIT", "SUCCEEDED", "FAILED", "CANCELLED", "UNKNOWN"),
        "RUNNING": ("SUCCEEDED", "RETRY_WAIT", "FAILED", "CANCELLED", "UNKNOWN"),
        "RETRY_WAIT": ("READY", "CANCELLED"),
        "UNKNOWN": ("SUBMITTING", "RUNNING", "RETRY_WAIT", "SUCCEEDED", "FAILED", "CANCELLED"),
    },
    "attempt": {
        "PENDING": ("SUBMITTING", "CANCELLED"),
        "SUBMITTING": ("RUNNING", "SUCCEEDED", "FAILED", "CANCELLED", "UNKNOWN"),
        "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED", "UNKNOWN"),
        "UNKNOWN": ("SUBMITTING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"),
    },
    "artifact": {"STAGING": ("COMMITTED", "ABORTED")},
}


def is_terminal(status: Column | str) -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*TERMINAL)


def moves(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """(kind, before, after) of the allowed moves; about fifty rows."""
    rows = [(k, before, after) for k, table in MOVES.items() if kind in (None, k) for before, nexts in table.items() for after in nexts]
    return spark.createDataFrame(rows, "kind string, before string, after string")
