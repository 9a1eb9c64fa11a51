"""Joins on ranges: capacity, and the revision in force at a time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.selection import positions
from quern.sources.shared import Scratch


#: Steps of an amount, and cells of all amounts but one, up to which what is offered is one small table.
STEPS, CELLS = 128, 32_768


def unsatisfied(requests: DataFrame, groups: DataFrame, keys: dict[str, str], kind: tuple[str, str] | None = None, satisfied: bool = False) -> DataFrame:
    """Requests that no worker group can hold (or those that one can): every amount of `keys` (request: group) must fit; null asks for nothing.

    `kind` (request column, group column): a request that names a kind needs a group of that kind. Only distinct requests are looked at.
    Where groups offer few different values of all amounts but one, one small table tells how much of that one goes with them, and requests are only looked up
    (see `_looked_up`). Else all amounts but two are turned into kinds (see `_as_kinds`), the last two are one sorted stream (see `_dominated`). So time is that of sorting,
    times a logarithm for each amount beyond two, and no request meets groups one by one.
    """
    scratch, n = Scratch(requests.sparkSession, "capacity"), len(keys)
    if not kind and n > 1 and (found := _looked_up(requests, groups, keys, satisfied, scratch)) is not None:
        return found
    any_kind = F.lit("*")
    wanted = F.coalesce(F.concat(F.lit("="), requests[kind[0]].cast("string")), any_kind) if kind else any_kind
    offered = F.array(any_kind, F.concat(F.lit("="), groups[kind[1]].cast("string"))) if kind else F.array(any_kind)
    amounts = [f"a{k}" for k in range(n)]
    asked = requests.select(wanted.alias("kind"), *(F.coalesce(requests[r], F.lit(0)).alias(a) for r, a in zip(keys, amounts, strict=True))).distinct()
    asked = scratch.save(asked.withColumn("id", F.monotonically_increasing_id()), "asked")
    offers = groups.select(F.explode(offered).alias("kind"), *(groups[g].alias(a) for g, a in zip(keys.values(), amounts, strict=True))).dropna().distinct()
    asks = asked
    while len(amounts) > 2:
        asks, offers = _as_kinds(asks, offers, amounts.pop(0), scratch)
    if n == 1:
        asks, offers, amounts = asks.withColumn("a1", F.lit(0)), offers.withColumn("a1", F.lit(0)), ["a0", "a1"]
    fits = _dominated(asks.select("kind", F.col(amounts[0]).alias("x"), F.col(amounts[1]).alias("y"), "id"), offers.select("kind", F.col(amounts[0]).alias("x"), F.col(amounts[1]).alias("y")), scratch)
    able = asked.join(fits, "id", "left_semi").drop("id")
    names = [fresh_name(requests, c) for c in able.columns]
    marked = requests.withColumns({names[0]: wanted, **{c: F.coalesce(requests[r], F.lit(0)) for c, r in zip(names[1:], keys, strict=True)}})
    return marked.join(able.toDF(*names), names, "left_semi" if satisfied else "left_anti").select(*(F.col(f"`{c}`") for c in requests.columns))


def _looked_up(requests: DataFrame, groups: DataFrame, keys: dict[str, str], satisfied: bool, scratch: Scratch) -> DataFrame | None:
    """`unsatisfied` by a table of what groups offer, None if that were large.

    All amounts but the one with the most values are steps. A cell is a step of each; it holds the largest last amount of the groups that
    have the cell's steps or more. A request takes the least step that is enough of each amount, and fits if the cell's last amount is enough.
    """
    offers = groups.select(*(groups[g].alias(f"o{k}") for k, g in enumerate(keys.values()))).dropna()
    sizes = list(offers.agg(*(F.count_distinct(c) for c in offers.columns)).first())
    last = max(range(len(sizes)), key=sizes.__getitem__)
    steps = [k for k in range(len(sizes)) if k != last]
    if max(sizes[k] for k in steps) > STEPS or math.prod(sizes[k] for k in steps) > CELLS:
        return None
    asks = [F.coalesce(requests[r], F.lit(0)) for r in keys]
    values = {k: [r[0] for r in offers.select(f"o{k}").distinct().orderBy(f"o{k}").collect()] for k in steps}  # at most STEPS each

    def step(amount: Column, k: int) -> Column:
        """How many of the values are less than the amount, by halving. One short expression: a sum of comparisons is too long a method for the JVM to compile."""
        offered, powers = F.array(*map(F.lit, values[k])), [1 << b for b in reversed(range(len(values[k]).bit_length()))]
        return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda n, p: F.when(F.get(offered, n + p - 1) < amount, n + p).otherwise(n)) if powers else F.lit(0)

    names = [f"__step{k}" for k in steps]
    top = offers.groupBy(*(step(F.col(f"o{k}"), k).alias(c) for k, c in zip(steps, names, strict=True))).agg(F.max(f"o{last}").alias("__top"))
    number, cells = F.col("id"), requests.sparkSession.range(math.prod(len(values[k]) for k in steps))
    for k, c in zip(steps, names, strict=True):
        cells, number = cells.withColumn(c, (number % len(values[k])).cast("int")), F.floor(number / F.lit(len(values[k])))
    cells = cells.join(top, names, "left").drop("id")
    for c in names:
        cells = cells.withColumn("__top", F.max("__top").over(Window.partitionBy(*(x for x in names if x != c)).orderBy(F.desc(c))))
    cells = scratch.save(cells, "cells")
    rows = requests.withColumns({**{c: step(asks[k], k) for k, c in zip(steps, names, strict=True)}, "__asked": asks[last]})
    fits = F.coalesce(F.col("__top") >= F.col("__asked"), F.lit(False))
    return rows.join(F.broadcast(cells), names, "left").filter(fits if satisfied else ~fits).select(*(F.col(f"`{c}`") for c in requests.columns))


def fresh_name(df: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def _as_kinds(asks: DataFrame, offers: DataFrame, amount: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Do without an amount: an offer's is at least an ask's in just those pairs whose rows have one kind in common in the result.

    All values of the amount are numbered in order, offers' numbers raised by one. Then the offer has enough if its number exceeds the
    ask's, that is if there is a bit that it has and the ask has not, with all higher bits equal. So each row goes under one kind for each
    such bit: the old kind, the bit's place and the bits above.
    """
    values = asks.select(F.col(amount).alias("value")).unionAll(offers.select(F.col(amount).alias("value"))).distinct()
    placed, n = positions(values, ["value"], "place")
    placed = scratch.save(placed, f"{amount}-places")

    def spread(df: DataFrame, number: Column, bit: int, name: str) -> DataFrame:
        rows = df.join(placed.withColumnRenamed("value", amount), amount).withColumn("number", number)
        bits = F.filter(F.sequence(F.lit(0), F.lit(n.bit_length())), lambda b: F.call_function("shiftright", F.col("number"), b).bitwiseAND(F.lit(1)) == bit)
        each = rows.withColumn("bit", F.explode(bits))
        under = F.concat_ws("|", "kind", F.col("bit").cast("string"), F.call_function("shiftright", F.col("number"), F.col("bit") + 1).cast("string"))
        return scratch.save(each.withColumn("kind", under).drop("place", "number", "bit", amount), f"{amount}-{name}")

    return spread(asks, F.col("place"), 0, "asks"), spread(offers, F.col("place") + 1, 1, "offers").distinct()


def _dominated(asks: DataFrame, offers: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of asks (kind, x, y, id) for which some offer (kind, x, y) of their kind has at least as much of both.

    Both are one stream by falling x, offers first, range-partitioned: an ask fits if the largest y of offers so far is enough. Of what
    lies in other ranges only one number a range is looked at. Asks with one x go to many ranges, by their ids.
    """
    offers = offers.groupBy("kind", "x").agg(F.max("y").alias("y"))
    both = offers.select("kind", "x", "y", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("id")).unionByName(asks.withColumn("asks", F.lit(1)))
    order = ["kind", F.desc("x"), "asks", "id"]
    both = scratch.save(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "stream")
    offer = F.when(F.col("asks") == 0, F.col("y"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("kind", "part").agg(F.max(offer).alias("top")).withColumn("above", F.max("top").over(before)).select("kind", "part", "above")
    inside = Window.partitionBy("kind", "part").orderBy(F.desc("x"), "asks").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = both.withColumn("best", F.max(offer).over(inside)).join(tops, ["kind", "part"]).filter("asks = 1")
    return best.filter(F.greatest("best", "above") >= F.col("y")).select("id").distinct()


def in_force(rows: DataFrame, revisions: DataFrame, key: str, at: str, since: str, fields: list[str], block_s: int = 30 * 86_400) -> DataFrame:
    """Each row with the newest revision of its key that began at or before the row's time; null before the first.

    Rows and revisions are one sorted stream for each key and block of `block_s` seconds, in which the last revision is
    carried forward; what was in force when a block begins comes from one revision a block. So a frequent key
    is many tasks' work, and there are no pairs of rows and revisions.
    """
    kind = rows.schema[at].dataType
    block = F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / F.lit(block_s)).alias("__block")
    rev_type = revisions.select(F.struct(*fields)).schema[0].dataType
    row_type = rows.select(F.struct(*rows.columns)).schema[0].dataType
    left = rows.select(F.struct(*rows.columns).alias("__row"), F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rev_type).alias("__rev")).select("*", block)
    right = revisions.select(F.lit(None).cast(row_type).alias("__row"), F.col(key).alias("__key"), F.col(since).cast(kind).alias("__at"), F.lit(0).alias("__kind"), F.struct(*fields).alias("__rev")).select("*", block)
    ends = right.groupBy("__key", "__block").agg(F.max_by("__rev", F.struct("__at", "__rev")).alias("__rev"))
    blocks = left.select("__key", "__block", F.lit(None).cast(rev_type).alias("__rev")).distinct().unionByName(ends).groupBy("__key", "__block").agg(F.max("__rev").alias("__rev"))
    earlier = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__rev", F.last("__rev", ignorenulls=True).over(earlier)).filter("__rev is not null")
    carried = carried.select(F.lit(None).cast(row_type).alias("__row"), "__key", F.lit(None).cast(kind).alias("__at"), F.lit(0).alias("__kind"), "__rev", "__block")
    order = Window.partitionBy("__key", "__block").orderBy("__at", "__kind", "__rev").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).unionByName(carried).withColumn("__rev", F.last("__rev", ignorenulls=True).over(order))
    return both.filter("__kind = 1").select("__row.*", *(F.col(f"__rev.{f}").alias(f if f not in rows.columns else f"revision_{f}") for f in fields))
