"""Reachability in graphs given as tables, in a number of rounds that grows with the logarithm of their depth.

The relation "in 2 ** k steps" is squared each round. It stays as large as the links in chains and in layers of bounded width, however deep they are; where
it would outgrow them, which happens in wide graphs, the rest is done level by level, after nodes with one link have been put together along their chains by pointer
doubling. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.segments import segments
from quern.sources.shared import Scratch

#: Pairs that a squared relation may have for each link, else rounds go level by level.
GROWTH = 16


def _pairs_of_square(left: DataFrame, right: DataFrame, grp: str) -> int:
    """Pairs that the join of two relations has before it is made distinct."""
    into = left.groupBy(grp, "on").agg(F.count("*").alias("n"))
    out = right.groupBy(grp, F.col("node").alias("on")).agg(F.count("*").alias("m"))
    return into.join(out, [grp, "on"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _by_levels(links: DataFrame, hit: DataFrame, grp: str) -> DataFrame:
    """The nodes of `hit` and all that reach them by `links`, a level each round."""
    scratch, front, k = Scratch(links.sparkSession, "levels"), hit, 0
    while True:
        front = links.join(front.select(grp, F.col("node").alias("on")), [grp, "on"], "left_semi").select(grp, "node").distinct().join(hit, [grp, "node"], "left_anti")
        front = scratch.save(front, f"level-{k}")
        if front.isEmpty():
            return hit
        hit = scratch.save(hit.unionAll(front), f"level-hit-{k}")
        k += 1


def _peeled(links: DataFrame, grp: str) -> DataFrame:
    """The nodes from which links go on without end: dead ends are taken off, a level each round."""
    scratch, k, n = Scratch(links.sparkSession, "peeled"), 0, links.count()
    while n:
        links = scratch.save(links.join(links.select(grp, F.col("node").alias("on")).distinct(), [grp, "on"], "left_semi").select(grp, "node", "on"), f"peeled-{k}")
        k, m = k + 1, links.count()
        if m == n:
            break
        n = m
    return links.select(grp, "node").distinct()


def reaching(links: DataFrame, hit: DataFrame, grp: str, scratch: Scratch, endless: bool = False) -> DataFrame:
    """The nodes of `hit` (grp, node) and all nodes from which `links` (grp, node, on) lead to one, at any distance; with `endless`, also those from which links go on for ever.

    A node at distance j of the nearest hit is found in round log2(j): the relation in 2 ** k steps leads it to a node
    that is nearer than 2 ** k, and so is known. Rows of nodes that are known are dropped after they have served in a round. What still has rows when 2 ** k
    exceeds the number of nodes goes on for ever.
    """
    links = scratch.save(links.select(grp, "node", "on").distinct(), "links")
    hit = scratch.save(hit.select(grp, "node").distinct(), "hit-0")
    most = links.count()
    rows, nodes, k = links, (links.groupBy(grp).agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 0), 0
    names: list[str] = []
    any_hit = not hit.isEmpty()
    while not rows.isEmpty() and 1 << k <= 2 * nodes:
        left = rows
        if any_hit:
            new = scratch.save(rows.join(hit.select(grp, F.col("node").alias("on")), [grp, "on"], "left_semi").select(grp, "node").distinct(), f"new-{k}")
            if not new.isEmpty():
                hit = scratch.save(hit.unionAll(new.join(hit, [grp, "node"], "left_anti")), f"hit-{k + 1}")
            left = rows.join(hit, [grp, "node"], "left_anti")
        if _pairs_of_square(left, rows, grp) > GROWTH * most:
            return _wide(links.join(hit, [grp, "node"], "left_anti"), hit, grp, scratch, endless)
        square = left.join(rows.select(grp, F.col("node").alias("on"), F.col("on").alias("next")), [grp, "on"]).select(grp, "node", F.col("next").alias("on")).distinct()
        rows = scratch.save(square, f"rows-{k}")
        scratch.drop(*names)
        names = [f"rows-{k}", f"new-{k}"]
        k += 1
    if not endless or rows.isEmpty():
        return hit
    return scratch.save(hit.unionAll(rows.select(grp, "node").distinct()), "endless")  # what leads to these has rows too


def _wide(links: DataFrame, hit: DataFrame, grp: str, scratch: Scratch, endless: bool) -> DataFrame:
    """As `reaching`, where no hit has links: nodes with one link go with the node that their chain leads to, the others level by level."""
    single = links.groupBy(grp, "node").agg(F.count("*").alias("n"), F.min("on").alias("parent")).filter("n = 1").drop("n")
    every = links.select(grp, F.col("on").alias("node")).unionAll(links.select(grp, "node")).distinct()
    heads = scratch.save(segments(every.join(single, [grp, "node"], "left"), grp), "heads")  # null where a chain leads round and round
    several = links.join(single.select(grp, "node"), [grp, "node"], "left_anti").join(heads.withColumnRenamed("node", "on"), [grp, "on"])
    several = scratch.save(several.select(grp, "node", F.col("segment").alias("on")).distinct(), "several")
    ahead = several.filter("on is not null")
    found = hit
    if endless:
        round_and_round = several.filter("on is null").select(grp, "node")
        found = scratch.save(hit.unionAll(round_and_round).unionAll(_peeled(ahead, grp)).distinct(), "begun")
    found = _by_levels(ahead, found, grp)
    whole = heads.join(found.select(grp, F.col("node").alias("segment"), F.lit(True).alias("there")), [grp, "segment"], "left")
    return scratch.save(whole.filter("there or segment is null" if endless else "there").select(grp, "node").unionAll(hit).distinct(), "found")


def endless_nodes(links: DataFrame, grp: str) -> DataFrame:
    """(grp, node): nodes from which `links` (grp, node, on) go on for ever, so nodes on cycles and those that lead to them."""
    return reaching(links, links.select(grp, "node").limit(0), grp, Scratch(links.sparkSession, "endless"), endless=True)
