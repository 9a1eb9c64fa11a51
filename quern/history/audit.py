"""Audits: rules that a database would enforce, checked over tables and pairs of snapshots. Each returns violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.states import moves


def _as_violations(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """rule, and the key's columns as one text."""
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys)).alias("key"))


def duplicates(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows: primary keys and unique constraints."""
    return _as_violations(rows.groupBy(*keys).count().filter("count > 1"), rule, keys)


def orphans(rows: DataFrame, parents: DataFrame, rule: str, keys: list[str], show: list[str] | None = None) -> DataFrame:
    """Rows whose parent is missing: foreign keys. A null key refers to nothing and is no violation."""
    return _as_violations(rows.dropna(subset=keys).join(parents.select(*keys).distinct(), keys, "left_anti"), rule, show or keys)


def failing(rows: DataFrame, rule: str, check: Column, show: list[str]) -> DataFrame:
    """Rows that fail a check; null passes, as in SQL."""
    return _as_violations(rows.filter(~check), rule, show)


def audit(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, violations)


def transitions(events: DataFrame, object_keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Each event with the state before it (null for the first)."""
    return events.withColumn("before", F.lag(state).over(Window.partitionBy(*object_keys).orderBy(*order)))


def forbidden_transitions(events: DataFrame, object_keys: list[str], state: str, order: list[str], kind: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Events that moved an object to a state that its state before doesn't allow. `allowed` has (before, after); else the moves of `kind` hold. Repeats of a state count as moves."""
    table = moves(events.sparkSession, kind).select("before", "after") if allowed is None else allowed
    steps = transitions(events, object_keys, state, order).filter("before is not null")
    return steps.join(F.broadcast(table.withColumnRenamed("after", state)), ["before", state], "left_anti").select(*events.columns, "before")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], fixed: list[str], state: str, kind: str = "artifact") -> DataFrame:
    """Rows whose change between two snapshots breaks a rule: rows may not vanish, `fixed` columns may not change, and the state may only stay or make an allowed move."""
    allowed = moves(old.sparkSession, kind).select(F.col("before").alias("__o"), F.col("after").alias("__n"), F.lit(True).alias("__ok"))
    o = old.select(*keys, F.lit(True).alias("__had"), F.col(state).alias("__o"), F.struct(*fixed).alias("__of"))
    n = new.select(*keys, F.lit(True).alias("__has"), F.col(state).alias("__n"), F.struct(*fixed).alias("__nf"))
    both = o.join(n, keys, "full").filter("__had").join(F.broadcast(allowed), ["__o", "__n"], "left")
    moved = F.coalesce(F.col("__o") != F.col("__n"), F.lit(False)) & F.col("__ok").isNull()
    reason = F.when(F.col("__has").isNull(), "deleted").when(~F.col("__of").eqNullSafe(F.col("__nf")), "identity changed").when(moved, "state may not change so")
    return both.select(*keys, reason.alias("violation")).filter("violation is not null")


def appended_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `old` that are missing or different in `new`: for append-only and immutable tables."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*rest).alias("__n"))
    both = old.select(*keys, F.struct(*rest).alias("__o")).join(n, keys, "left")
    return both.filter(F.col("__n").isNull() | ~F.col("__o").eqNullSafe(F.col("__n"))).select(*keys, F.when(F.col("__n").isNull(), "deleted").otherwise("changed").alias("violation"))
