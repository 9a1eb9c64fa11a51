"""Bounded, fair and rotating selections of rows, without a task that sees all rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import Scratch

_ROW_BITS = 33  # of monotonically_increasing_id


def positions(df: DataFrame, order: list[str | Column], to: str = "position") -> tuple[DataFrame, int]:
    """Rows with their place in the order, gapless from 0, and the number of rows. `order` must be unique for stable places.

    Rows are range-partitioned and sorted; only one count for each partition is looked at together.
    """
    scratch = Scratch(df.sparkSession, "positions")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    split = F.shiftright("__id", _ROW_BITS).alias("__part")
    counts = rows.groupBy(split).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.save(counts.select("__part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0
    placed = rows.withColumn("__part", F.shiftright("__id", _ROW_BITS)).join(F.broadcast(offsets.drop("n")), "__part")
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(to, place).drop("__part", "__id", "__before"), total


def rotating_slice(df: DataFrame, order: list[str], cursor: int, n: int) -> tuple[DataFrame, int]:
    """`n` rows of a stable order from `cursor` on, wrapping at the end, and the next cursor. All rows, and 0, if they fit."""
    placed, total = positions(df, order)
    if total <= n:
        return placed.drop("position"), 0
    start = cursor % total
    return placed.filter(F.pmod(F.col("position") - start, F.lit(total)) < n).drop("position"), (start + n) % total


def fair_take(df: DataFrame, group: str, within: list[str], between: list[str], n: int, last: DataFrame | None = None) -> DataFrame:
    """`n` rows, one group at a time: the group served least recently is next, with its earliest row.

    `within` orders a group's rows; `between` orders groups served equally long ago; `last` gives (group,
    last_sequence) of earlier service. The k-th row of a group is served in the k-th round; in the first
    round, groups come by their last service. Columns `round` and `last_sequence` are added.
    """
    rows = df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*within)))
    rows = rows.filter(F.col("round") <= n)
    if last is not None:
        rows = rows.join(last.select(group, "last_sequence"), group, "left")
    else:
        rows = rows.withColumn("last_sequence", F.lit(None).cast("long"))
    rows = rows.withColumn("last_sequence", F.coalesce("last_sequence", F.lit(0)))
    return rows.orderBy("round", "last_sequence", *between, group).limit(max(n, 0))


def fair_take_capped(df: DataFrame, group: str, category: str, within: list[str], between: list[str], n: int, free: dict[str, int], last: DataFrame | None = None) -> DataFrame:
    """As `fair_take`, but a category takes only as many rows as it has slots in `free` (none given: no bound).

    A full category is skipped and its groups go on with other rows, so there is no closed form. But no row
    can be taken that has min(n, slots) rows of its group and category before it, and among first rows only
    the first n groups of each category and last service can matter; both are dropped first. The greedy
    choice then runs over at most n rows of each (group, category) for at most n groups of a category.
    """
    if n <= 0:
        return df.withColumn("sequence", F.lit(None).cast("int")).limit(0)
    slots = F.lit(n)
    for name, k in free.items():
        slots = F.when(F.col(category) == name, F.lit(min(k, n))).otherwise(slots)
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(group, category).orderBy(*within))).filter(F.col("__k") <= slots)
    if last is not None:
        rows = rows.join(last.select(group, F.col("last_sequence").alias("__last")), group, "left")
    else:
        rows = rows.withColumn("__last", F.lit(0).cast("long"))
    rows = rows.withColumn("__last", F.coalesce("__last", F.lit(0)))
    first = F.struct("__last", *between, group)
    lead = rows.filter("__k = 1").select(group, category, F.row_number().over(Window.partitionBy(category).orderBy(first)).alias("__g")).filter(F.col("__g") <= n)
    rows = rows.join(lead.select(group).distinct(), group, "left_semi")
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", sequence int"

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pd.concat(parts).sort_values(within, kind="stable")
        left, taken = dict(free), []
        waiting: dict[object, list] = {}
        for record in table.to_dict("records"):
            waiting.setdefault(record[group], []).append(record)
        queue = [((v[0]["__last"], *(v[0][b] for b in between), (k is None, k)), k) for k, v in waiting.items()]
        heapq.heapify(queue)
        served = max((q[0][0] for q in queue), default=0)
        while queue and len(taken) < n:
            key, g = heapq.heappop(queue)
            at = next((i for i, r in enumerate(waiting[g]) if left.get(r[category], 1) > 0), None)
            if at is None:
                continue  # its categories are full and stay so
            record = waiting[g].pop(at)
            if record[category] in left:
                left[record[category]] -= 1
            served += 1
            taken.append({**{c: record[c] for c in names}, "sequence": len(taken) + 1})
            if waiting[g]:
                heapq.heappush(queue, ((served, *key[1:]), g))
        yield pd.DataFrame(taken, columns=[*names, "sequence"])

    return rows.repartition(1).mapInPandas(choose, schema)
