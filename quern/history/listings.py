"""Lookups over run history: listings, latest revisions, slots and diagnostics. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.states import RECOVERABLE_UNIT_STATES, RESERVED_UNIT_STATES, is_terminal
from quern.operators.selection import positions
from quern.sources.shared import Scratch

MAX_PAGE, MAX_EVENTS = 500, 1000


def page(rows: DataFrame, order: list[str], limit: int = 100, offset: int = 0, **equal: object) -> DataFrame:
    """One page of a listing: rows where the given columns equal the given values, in order. `order` must be unique for a stable page."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE} and offset not negative")
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*order).offset(offset).limit(limit)


def next_version(rows: DataFrame, parents: DataFrame, parent: str, version: str) -> DataFrame:
    """(parent, next version): one more than the highest, 1 for a parent without any."""
    top = rows.groupBy(parent).agg(F.max(version).alias("top"))
    return parents.select(parent).distinct().join(top, parent, "left").select(parent, (F.coalesce("top", F.lit(0)) + 1).cast("int").alias("next_version"))


def number_new(rows: DataFrame, new: DataFrame, parent: str, version: str, order: list[str]) -> DataFrame:
    """`new` rows with versions that go on after their parent's highest."""
    top = rows.groupBy(parent).agg(F.max(version).alias("__top"))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return new.join(top, parent, "left").withColumn(version, (F.coalesce("__top", F.lit(0)) + rank).cast("int")).drop("__top")


def newest(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The row with the highest revision of each key. Aggregates before the shuffle, as a window could not."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), revision).alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def newest_of(rows: DataFrame, revision: str, **equal: object) -> DataFrame:
    """The newest row among those with the given values."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc(revision)).limit(1)


def with_default(stored: DataFrame, default: DataFrame, key: str) -> DataFrame:
    """`stored` and those rows of `default` whose key isn't stored. `default` is a small built-in table."""
    missing = default.join(stored.select(key), key, "left_anti").select(*default.columns)
    return missing.unionByName(stored.select(*default.columns))


def active(rows: DataFrame, order: list[str], status: str = "status") -> DataFrame:
    """Rows in no terminal state: active runs, recoverable units."""
    return rows.filter(~is_terminal(status)).orderBy(*order)


def children(rows: DataFrame, order: list[str], **equal: object) -> DataFrame:
    """Rows of one parent in order: units of a run, attempts of a unit, events of a run, artifacts of a run."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*order)


def current_attempts(units: DataFrame, attempts: DataFrame, unit_keys: list[str]) -> DataFrame:
    """Each unit with its current attempt; units without one are left out."""
    u = units.select(*unit_keys, F.col("current_attempt").alias("attempt_number"), F.col("status").alias("unit_status"))
    return u.join(attempts, [*unit_keys, "attempt_number"])


def attempt_runs(units: DataFrame, attempts: DataFrame, unit_keys: list[str], run: str = "run_id") -> DataFrame:
    """Each attempt with the run of its unit."""
    extra = [run] if run not in unit_keys else []
    return attempts.join(units.select(*unit_keys, *extra, "cluster_profile"), unit_keys)


def latest_job(attempts: DataFrame, unit_keys: list[str]) -> DataFrame:
    """The last external job id that isn't empty, of each unit that has one."""
    named = attempts.filter("external_job_id is not null and external_job_id <> ''")
    return named.groupBy(*unit_keys).agg(F.max_by("external_job_id", "attempt_number").alias("latest_job_id"))


def artifacts_by_unit(artifacts: DataFrame, unit_keys: list[str], fields: list[str]) -> DataFrame:
    """Each unit's artifacts as one sorted array; rows without a unit are skipped. A unit has as many as attempts."""
    known = artifacts.dropna(subset=unit_keys)
    return known.groupBy(*unit_keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("artifacts"))


def last_events(events: DataFrame, n: int, run: str = "run_id", order: str = "event_id") -> DataFrame:
    """The last `n` events of each run."""
    if not 1 <= n <= MAX_EVENTS:
        raise ValueError(f"the number of events must be 1 to {MAX_EVENTS}")
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))
    return events.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def diagnostics(runs: DataFrame, versions: DataFrame, pipelines: DataFrame, units: DataFrame, attempts: DataFrame, artifacts: DataFrame, events: DataFrame | None = None, last: int = 200) -> DataFrame:
    """A row for each run: its pipeline and version, units with attempts and artifacts, and its last events."""
    tries = attempts.groupBy("run_id", "unit_key").agg(F.array_sort(F.collect_list(F.struct("attempt_number", "status", "error_code", "external_job_id"))).alias("attempts"))
    files = artifacts_by_unit(artifacts.withColumnRenamed("node_id", "unit_key"), ["run_id", "unit_key"], ["attempt_number", "state", "committed_uri", "size_bytes"])
    nested = units.select("run_id", "unit_key", "status", "cluster_profile").join(tries, ["run_id", "unit_key"], "left").join(files, ["run_id", "unit_key"], "left")
    nested = nested.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("unit_key", "status", "cluster_profile", "attempts", "artifacts"))).alias("units"))
    out = runs.join(versions.select("version_id", "pipeline_id", "version"), "version_id", "left")
    out = out.join(pipelines.select("pipeline_id", "tenant_id", F.col("name").alias("pipeline_name")), "pipeline_id", "left").join(nested, "run_id", "left")
    if events is not None:
        tail = last_events(events, last).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "created_at"))).alias("events"))
        out = out.join(tail, "run_id", "left")
    return out


def slots(admissions: DataFrame) -> DataFrame:
    """Admitted and waiting units by profile, and in all (profile null)."""
    counts = admissions.rollup("cluster_profile").agg(F.count_if(F.col("state") == "ADMITTED").alias("admitted"), F.count_if(F.col("state") == "WAITING").alias("waiting"))
    return counts


def last_sequences(admissions: DataFrame, run: str = "run_id") -> DataFrame:
    return admissions.groupBy(run).agg(F.coalesce(F.max("admission_sequence"), F.lit(0)).cast("long").alias("last_sequence"))


def reconcile_admissions(admissions: DataFrame, units: DataFrame, now: Column, keys: tuple[str, str] = ("run_id", "unit_key")) -> DataFrame:
    """The next snapshot of admissions: release, recover, queue, in that order, with the action that applied.

    Waiting and admitted units that left the reserved states are released; active units that aren't admitted
    are admitted with sequence numbers that go on from the highest one, in order of creation; ready units
    without a row wait, and released ones wait again.
    """
    u = units.select(*keys, F.col("status").alias("u_status"), F.col("cluster_profile").alias("u_profile"), F.col("created_at").alias("u_created"))
    a = admissions.select(*keys, "cluster_profile", "queued_at", "state", "admission_sequence")
    both = a.join(u, list(keys), "full")
    gone = F.col("state").isin("WAITING", "ADMITTED") & ~F.col("u_status").isin(*RESERVED_UNIT_STATES)
    state1 = F.when(gone, "RELEASED").otherwise(F.col("state"))
    recover = F.col("u_status").isin(*RECOVERABLE_UNIT_STATES) & ~F.coalesce(state1 == "ADMITTED", F.lit(False))
    requeue = (F.col("u_status") == "READY") & (F.col("state").isNull() | (F.col("state") == "RELEASED"))
    action = F.when(recover, "RECOVERED").when(requeue, "QUEUED").when(gone, "RELEASED").otherwise("KEPT")
    state = F.when(recover, "ADMITTED").when(requeue, "WAITING").otherwise(state1)
    both = both.withColumn("action", action).withColumn("next_state", state)
    both = Scratch(admissions.sparkSession, "reconciled").save(both, "both")  # joined once; what is recovered is then numbered apart
    last = both.agg(F.coalesce(F.max("admission_sequence"), F.lit(0))).first()[0]
    both = both.filter("next_state is not null")
    again, _ = positions(both.filter("action = 'RECOVERED'"), ["u_created", *reversed(keys)])
    numbered = again.select(*both.columns, (F.col("position") + last + 1).alias("new_sequence"))
    both = both.filter("action <> 'RECOVERED'").withColumn("new_sequence", F.lit(None).cast("long")).unionAll(numbered)
    return both.select(
        *keys, F.when((F.col("action") == "RECOVERED") | F.col("state").isNull(), F.col("u_profile")).otherwise(F.col("cluster_profile")).alias("cluster_profile"), F.col("next_state").alias("state"),
        F.when(F.col("action") == "RECOVERED", F.col("new_sequence")).otherwise(F.col("admission_sequence")).cast("long").alias("admission_sequence"),
        F.when((F.col("action") == "QUEUED") | F.col("state").isNull(), now).otherwise(F.col("queued_at")).alias("queued_at"), "action",
    )


def candidates(admissions: DataFrame, units: DataFrame, runs: DataFrame) -> DataFrame:
    """Waiting admissions whose unit is ready and whose run is running."""
    waiting = admissions.filter("state = 'WAITING'").select("run_id", "unit_key", "cluster_profile", "queued_at")
    ready = units.filter("status = 'READY'").select("run_id", "unit_key", F.col("created_at").alias("unit_created_at"))
    running = runs.filter("status = 'RUNNING'").select("run_id", F.col("created_at").alias("run_created_at"))
    return waiting.join(ready, ["run_id", "unit_key"]).join(running, "run_id")


def in_sequence(admissions: DataFrame, tie: list[str]) -> DataFrame:
    return admissions.orderBy(F.asc_nulls_last("admission_sequence"), *tie)
