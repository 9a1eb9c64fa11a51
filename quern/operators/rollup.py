"""States of units and runs that follow from those of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.states import WAITING_UNIT_STATES, is_terminal
from quern.operators.reach import reaching
from quern.sources.shared import Scratch


def dependencies(units: DataFrame, depends_on: str, unit: str = "unit_no", run: str = "run_id") -> DataFrame:
    """(run, unit, dependency, dependency's state): one row for each dependency. `depends_on` is a column with one id or an array of them."""
    array = F.col(depends_on) if units.schema[depends_on].dataType.typeName() == "array" else F.array_compact(F.array(depends_on))
    edges = units.select(run, unit, F.explode(array).alias("dep"))
    return edges.join(units.select(run, F.col(unit).alias("dep"), F.col("status").alias("dep_status")), [run, "dep"], "left")


def missing_dependencies(units: DataFrame, depends_on: str, unit: str = "unit_no", run: str = "run_id") -> DataFrame:
    return dependencies(units, depends_on, unit, run).filter("dep_status is null").select(run, unit, "dep")


def ready_units(units: DataFrame, depends_on: str, unit: str = "unit_no", run: str = "run_id") -> DataFrame:
    """Pending units all of whose dependencies have succeeded; without dependencies a unit is ready. A missing dependency blocks."""
    done = dependencies(units, depends_on, unit, run).groupBy(run, unit).agg(F.bool_and(F.coalesce(F.col("dep_status") == "SUCCEEDED", F.lit(False))).alias("done"))
    return units.filter("status = 'PENDING'").join(done, [run, unit], "left").filter(F.coalesce("done", F.lit(True))).drop("done")


def cancelled_by_upstream(units: DataFrame, depends_on: str, unit: str = "unit_no", run: str = "run_id") -> DataFrame:
    """The next snapshot: pending units below a failed or cancelled one, at any distance through pending ones, are cancelled.

    They are reached in rounds that grow with the logarithm of their depth (see `quern.operators.reach`).
    """
    scratch = Scratch(units.sparkSession, "cancel")
    deps = dependencies(units, depends_on, unit, run).select(run, F.col(unit).alias("node"), F.col("dep").alias("on"))
    pending = units.filter("status = 'PENDING'").select(run, F.col(unit).alias("node"))
    bad = units.filter("status in ('FAILED', 'CANCELLED')").select(run, F.col(unit).alias("node"))
    hit = reaching(deps.join(pending, [run, "node"], "left_semi"), bad, run, scratch)
    reached = hit.select(run, F.col("node").alias(unit), F.lit(True).alias("__hit"))
    return units.join(reached, [run, unit], "left").withColumn("status", F.when(F.col("__hit") & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status"))).select(*units.columns)


def run_states(units: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, status, reason) that running runs take from their units; null where nothing follows yet."""
    every = units.groupBy(run).agg(
        F.bool_and(F.col("status") == "SUCCEEDED").alias("ok"), F.bool_and(is_terminal("status")).alias("over"),
        F.bool_or(F.col("status") == "FAILED").alias("failed"), F.bool_or(F.col("status") == "CANCELLED").alias("cancelled"),
    )
    bad = F.col("over") & (F.col("failed") | F.col("cancelled"))
    reason = F.when(F.col("failed"), "EXECUTION_UNIT_FAILED").otherwise("EXECUTION_UNIT_CANCELLED")
    return every.select(run, F.when(F.col("ok"), "SUCCEEDED").when(bad, "FAILED").alias("status"), F.when(~F.col("ok") & bad, reason).alias("reason"))


def cancel_runs(units: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The next snapshot of units: those still waiting in a cancelled run are cancelled."""
    gone = runs.filter("status = 'CANCELLED'").select(run, F.lit(True).alias("__gone"))
    return units.join(gone, run, "left").withColumn("status", F.when(F.col("__gone") & F.col("status").isin(*WAITING_UNIT_STATES), "CANCELLED").otherwise(F.col("status"))).select(*units.columns)


def first_times(events: DataFrame, key: str, state: str, at: str, names: dict[str, list[str]]) -> DataFrame:
    """For each object, the first time it entered any of the states given for each name, null if it never did."""

    def first(states: list[str]) -> Column:
        return F.min(F.when(F.col(state).isin(*states), F.col(at)))

    return events.groupBy(key).agg(*(first(s).alias(n) for n, s in names.items()))
