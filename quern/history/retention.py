"""Retention over run history: what may be deleted, why something may not, and the next state of the target table.

Windows are seconds; `now` is always given, never the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.states import is_terminal

KEYS = ["run_id", "node_id", "attempt_number"]


@dataclass(frozen=True)
class Windows:
    run_s: int
    event_s: int
    staging_s: int
    committed_s: int

    def __post_init__(self) -> None:
        if min(self.run_s, self.event_s, self.staging_s, self.committed_s) < 0:
            raise ValueError("retention windows can't be negative")


def plus(at: Column, seconds: int) -> Column:
    return at + F.make_dt_interval(secs=F.lit(seconds))


def with_owners(artifacts: DataFrame, runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Artifacts with the state and end of their run and attempt. Rows without either are left out."""
    r = runs.select("run_id", F.col("status").alias("run_status"), F.col("finished_at").alias("run_finished_at"))
    t = attempts.select("run_id", F.col("unit_key").alias("node_id"), "attempt_number", F.col("status").alias("attempt_status"), F.col("finished_at").alias("attempt_finished_at"))
    return artifacts.join(r, "run_id").join(t, KEYS)


def _staging_at(w: Windows) -> Column:
    return F.when(is_terminal("attempt_status"), plus(F.col("attempt_finished_at"), w.staging_s))


def _committed_at(w: Windows, committed_at: str) -> Column:
    known = F.col("run_finished_at").isNotNull() & F.col(committed_at).isNotNull()
    return F.when((F.col("state") == "COMMITTED") & is_terminal("run_status") & known, F.greatest(plus(F.col("run_finished_at"), w.run_s), plus(F.col(committed_at), w.committed_s)))


def candidates(owned: DataFrame, w: Windows, now: Column, order: list[str], limit: int | None = None, committed_at: str = "finished_at") -> DataFrame:
    """Artifacts with at least one part that may go by now, in order, at most `limit`."""
    rows = owned.filter((_staging_at(w) <= now) | (_committed_at(w, committed_at) <= now))
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def after(rows: DataFrame, order: list[str], last: tuple | None, limit: int) -> DataFrame:
    """Keyset scan: the next `limit` rows after the key `last`; from the start when `last` is None or nothing follows it.

    The key is a filter that reaches the scan, so a table written by `write_clustered` is read from the key's row group on. Only
    where nothing follows, which one row of the same scan tells, is the table's beginning read.
    """
    if last is not None:
        later = rows.filter(follows(order, last))
        if not later.isEmpty():
            rows = later
    return rows.orderBy(*order).limit(limit)


def follows(order: list[str], last: tuple) -> Column:
    """Whether a row's key comes after `last`. The first part is said once more on its own, for scans that skip by one column."""
    later = F.lit(False)
    for k in range(len(order) - 1, -1, -1):
        column, value = F.col(order[k]), F.lit(last[k])
        later = (column > value) | ((column == value) & later) if k < len(order) - 1 else column > value
    return (F.col(order[0]) >= F.lit(last[0])) & later


def write_clustered(rows: DataFrame, path: str, order: list[str], **options: str) -> None:
    """Write rows in order of a key, files and row groups too, so that filters on it skip the others."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).parquet(path)


def targets(owned: DataFrame, w: Windows, now: Column, committed_at: str = "finished_at") -> DataFrame:
    """Deletion targets that are due: none, one or two for each artifact."""
    each = F.array(
        F.struct(F.lit("STAGING").alias("target_kind"), F.col("staging_uri").alias("uri"), _staging_at(w).alias("eligible_at")),
        F.struct(F.lit("COMMITTED").alias("target_kind"), F.col("committed_uri").alias("uri"), _committed_at(w, committed_at).alias("eligible_at")),
    )
    return owned.select(*KEYS, F.explode(each).alias("t")).select(*KEYS, "t.*").filter(F.col("eligible_at") <= now)


def upsert_targets(known: DataFrame, found: DataFrame) -> DataFrame:
    """The next snapshot of the target table: new targets are pending, known ones get the new address and time unless deleted."""
    key = [*KEYS, "target_kind"]
    k = known.select(*key, "uri", "eligible_at", "attempts", "state")
    f = found.select(*key, F.col("uri").alias("new_uri"), F.col("eligible_at").alias("new_at"))
    change = F.col("new_uri").isNotNull() & ~F.coalesce(F.col("state") == "DELETED", F.lit(False))
    return k.join(f, key, "full").select(
        *key, F.when(change, F.col("new_uri")).otherwise(F.col("uri")).alias("uri"), F.when(change, F.col("new_at")).otherwise(F.col("eligible_at")).alias("eligible_at"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("state", F.lit("PENDING")).alias("state"),
    )


def work(known: DataFrame, now: Column, order: list[str], limit: int) -> DataFrame:
    """Targets to process next."""
    return known.filter((F.col("state") != "DELETED") & (F.col("eligible_at") <= now)).orderBy(*order).limit(limit)


def active_references(inputs: DataFrame, runs: DataFrame, uri: str = "input_uri") -> DataFrame:
    """Addresses that runs in no terminal state read."""
    open_runs = runs.filter(~is_terminal("status")).select("run_id")
    return inputs.join(open_runs, "run_id", "left_semi").select(F.col(uri).alias("uri")).distinct()


def input_addresses(rows: DataFrame, artifacts: str, uri: str = "uri") -> DataFrame:
    """(run_id, input_uri) of each entry of an array column of artifact records."""
    return rows.select("run_id", F.explode(artifacts).alias("a")).select("run_id", F.col(f"a.{uri}").alias("input_uri"))


# The texts of the reasons.
REASONS = (
    "artifact metadata no longer exists",
    "attempt is not terminal",
    "staging retention window has not elapsed",
    "artifact is not committed",
    "owning run is not terminal",
    "run retention window has not elapsed",
    "artifact retention window has not elapsed",
    "committed artifact is referenced by an active run",
)


def block_reasons(known: DataFrame, owned: DataFrame, referenced: DataFrame, w: Windows, now: Column, committed_at: str = "finished_at") -> DataFrame:
    """Targets with `reason`: the first that forbids deletion, null if none does."""
    facts = owned.select(*KEYS, F.col("state").alias("artifact_state"), "run_status", "run_finished_at", "attempt_status", "attempt_finished_at", F.col(committed_at).alias("committed_at"), F.lit(True).alias("exists"))
    rows = known.join(facts, KEYS, "left").join(referenced.select("uri", F.lit(True).alias("in_use")), "uri", "left")
    open_attempt = ~F.coalesce(is_terminal("attempt_status"), F.lit(False)) | F.col("attempt_finished_at").isNull()
    open_run = ~F.coalesce(is_terminal("run_status"), F.lit(False)) | F.col("run_finished_at").isNull()
    young = F.col("committed_at").isNull() | (plus(F.col("committed_at"), w.committed_s) > now)
    staging = F.when(open_attempt, REASONS[1]).when(plus(F.col("attempt_finished_at"), w.staging_s) > now, REASONS[2])
    committed = (
        F.when(F.col("artifact_state") != "COMMITTED", REASONS[3]).when(open_run, REASONS[4]).when(plus(F.col("run_finished_at"), w.run_s) > now, REASONS[5])
        .when(young, REASONS[6]).when(F.col("in_use"), REASONS[7])
    )
    reason = F.when(F.col("exists").isNull(), REASONS[0]).when(F.col("target_kind") == "STAGING", staging).otherwise(committed)
    return rows.select(*known.columns, reason.alias("reason"))


def prunable_events(events: DataFrame, runs: DataFrame, w: Windows, now: Column) -> DataFrame:
    """Old events of runs that ended long ago."""
    old = runs.filter(is_terminal("status") & (plus(F.col("finished_at"), w.run_s) <= now)).select("run_id")
    return events.filter(plus(F.col("created_at"), w.event_s) <= now).join(old, "run_id", "left_semi")


def prune_events(events: DataFrame, runs: DataFrame, w: Windows, now: Column) -> DataFrame:
    """The next snapshot of the events: all but the prunable ones."""
    old = runs.filter(is_terminal("status") & (plus(F.col("finished_at"), w.run_s) <= now)).select("run_id", F.lit(True).alias("__old"))
    joined = events.join(old, "run_id", "left")
    return joined.filter(F.col("__old").isNull() | ~F.coalesce(plus(F.col("created_at"), w.event_s) <= now, F.lit(False))).select(*events.columns)


def target_states(processed: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of processed targets (reason, error, objects): blocked, failed or deleted."""
    state = F.when(F.col("reason").isNotNull(), "BLOCKED").when(F.col("error").isNotNull(), "FAILED").otherwise("DELETED")
    tried = F.col("reason").isNull()
    return processed.select(
        *KEYS, "target_kind", "uri", "eligible_at", (F.col("attempts") + tried.cast("int")).alias("attempts"), state.alias("state"),
        F.substring(F.coalesce("reason", "error"), 1, 1000).alias("last_error"), F.when(state == "DELETED", F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")).alias("deleted_at"), "objects",
    )


def report(states: DataFrame, scanned: DataFrame, found: DataFrame, pruned: DataFrame) -> DataFrame:
    """Totals of one pass, in one row: artifacts looked at, targets found for them, targets processed by outcome, objects deleted and events pruned."""
    n = {f"{s.lower()}_targets": F.count_if(F.col("state") == s) for s in ("DELETED", "BLOCKED", "FAILED")}
    out = states.agg(F.count("*").alias("processed_targets"), *(c.alias(k) for k, c in n.items()), F.coalesce(F.sum(F.when(F.col("state") == "DELETED", F.col("objects"))), F.lit(0)).cast("long").alias("objects_deleted"))
    for rows, name in ((scanned, "scanned_artifacts"), (found, "discovered_targets"), (pruned, "events_pruned")):
        out = out.join(rows.agg(F.count("*").alias(name)), F.lit(True))  # one row each
    return out
