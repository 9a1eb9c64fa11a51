"""Classification of outcomes: retries, raw job states, errors of a remote interface."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes and raw states.
RETRYABLE_CODES = ("API_UNAVAILABLE", "CLUSTER_UNAVAILABLE", "EXTERNAL_JOB_NOT_FOUND", "RAY_CLUSTER_FAILED")
PERMANENT_CODES = ("INVALID_PLAN", "USER_CODE_ERROR", "IMAGE_PULL_ERROR")
RAW_STATES = {
    "PENDING": ("PENDING", "WAITING", "NEW", "INITIALIZING"),
    "RUNNING": ("RUNNING",),
    "SUCCEEDED": ("SUCCEEDED", "SUCCESS", "COMPLETE", "COMPLETED"),
    "FAILED": ("FAILED", "FAILURE", "VALIDATIONFAILED"),
    "CANCELLED": ("STOPPED", "CANCELLED", "CANCELED"),
}
RETRYABLE_STATUSES = (408, 429)


@dataclass(frozen=True)
class Retries:
    max_attempts: int = 3
    initial_s: float = 30.0
    multiplier: float = 2.0
    max_s: float = 600.0

    def __post_init__(self) -> None:
        if self.max_attempts < 1 or self.initial_s < 0 or self.multiplier < 1 or self.max_s < 0:
            raise ValueError("at least one attempt, a multiplier of at least 1, and no negative times")

    def backoff(self, attempt: Column) -> Column:
        """Seconds to wait after an attempt."""
        return F.least(F.lit(self.initial_s) * F.pow(F.lit(self.multiplier), attempt - 1), F.lit(self.max_s))

    def retry_at(self, finished_at: Column, attempt: Column) -> Column:
        return finished_at + F.make_dt_interval(secs=self.backoff(attempt).cast("decimal(18,6)"))

    def retries_job(self, attempt: Column, flag: Column, code: Column, state: Column) -> Column:
        """Whether a job's outcome is retried: attempts left, then its own flag, then its code, then only unknown states."""
        by_code = F.when(code.isin(*PERMANENT_CODES), False).when(code.isin(*RETRYABLE_CODES), True)
        return F.when(attempt >= self.max_attempts, False).when(flag.isNotNull(), flag).otherwise(F.coalesce(by_code, state == "UNKNOWN"))

    def retries_error(self, attempt: Column, flag: Column, code: Column) -> Column:
        """Whether a failed submission is retried: here the flag comes last."""
        by_code = F.when(code.isin(*PERMANENT_CODES), False).when(code.isin(*RETRYABLE_CODES), True)
        return F.when(attempt >= self.max_attempts, False).otherwise(F.coalesce(by_code, flag))


def job_state(raw: Column) -> Column:
    """One of six states; anything else, and null, is UNKNOWN."""
    out: Column | None = None
    for state, names in RAW_STATES.items():
        hit = F.upper(raw).isin(*names)
        out = F.when(hit, state) if out is None else out.when(hit, state)
    return out.otherwise("UNKNOWN")


def job_error(raw: Column, reason: Column) -> Column:
    """A job's error code: its reason, or a general one for failures without."""
    named = F.when(reason != "", reason)
    return F.when(F.upper(raw) == "VALIDATIONFAILED", "INVALID_PLAN").otherwise(F.coalesce(named, F.when(job_state(raw) == "FAILED", "RAY_JOB_FAILED")))


def job_retryable(raw: Column) -> Column:
    return F.when(F.upper(raw) == "VALIDATIONFAILED", False)


def api_retryable(status: Column) -> Column:
    return status.isNull() | status.isin(*RETRYABLE_STATUSES) | (status >= 500)


def api_error(status: Column) -> Column:
    return F.when(status == 422, "INVALID_PLAN").when(api_retryable(status), "API_UNAVAILABLE").otherwise("KUBERNETES_API_ERROR")
