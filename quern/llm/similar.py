"""Links between alike things found in buckets, and connected components, as DataFrame jobs.

No pairs within a bucket are listed as such. Each bucket has leaders that its members are compared with, one
in the first round and four times as many in each further one. A member that has led is compared with all of its
bucket, so it leaves it; buckets whose members are all in one component are left out. Once what remains is
small, all are leaders. Members and leaders of a large bucket meet in cells of some CELL of either, so no task has more than CELL * CELL pairs of one key. In the end everything has been compared with all that it shares a bucket with, so no link is lost.

Which leaders are taken, and when, costs time only: the links are the same.

Tables here are small beside the input, but grow with it: joins merge sorted rows, and none is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) for each id of `edges` (a, b); ids of one connected component share a root.

    Union-find by contraction: in each round a vertex moves to the vertex with the least hash within two
    steps, edges follow, and those inside a vertex vanish. Hashes differ by round, so paths shrink by a
    constant factor as stars do at once. Each round is written to the shared folder and takes the place of the last; the moves are put together at the end.
    All tables lie in the folder `name`, which the caller may drop once it no longer reads what is returned. Ids are of type long.
    """
    edges = scratch.save(edges.select("a", "b").filter("a <> b").distinct(), f"{name}/edges-0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(steps)
        both = edges.unionAll(edges.select("b", "a")).toDF("id", "to")
        order = F.xxhash64(F.lit(k), "to")
        near = both.groupBy("id").agg(F.min(order).alias("h1"), F.min_by("to", order).alias("to1"))
        own = F.xxhash64(F.lit(k), "id")
        near = near.select("id", F.least("h1", own).alias("h"), F.when(F.col("h1") < own, F.col("to1")).otherwise(F.col("id")).alias("to"))
        far = both.join(near.select(F.col("id").alias("to"), "h", F.col("to").alias("root")).hint("merge"), "to").groupBy("id").agg(F.min("h").alias("h2"), F.min_by("root", "h").alias("root2"))
        step = near.join(far.hint("merge"), "id").select("id", F.when(F.col("h2") < F.col("h"), F.col("root2")).otherwise(F.col("to")).alias("root"))
        step = scratch.save(step, f"{name}/step-{k}")
        after = edges.join(step.toDF("a", "a2").hint("merge"), "a").join(step.toDF("b", "b2").hint("merge"), "b").filter("a2 <> b2")
        after = scratch.save(after.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}/edges-{k + 1}")
        scratch.drop(f"{name}/edges-{k}")
        steps.append(step)
        edges = after
    scratch.drop(f"{name}/edges-{len(steps)}")
    if not steps:
        return scratch.spark.createDataFrame([], "id long, root long")
    if len(steps) == 1:
        return steps[0]
    roots = steps[0]
    for step in steps[1:]:
        roots = roots.join(step.toDF("root", "next").hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    roots = scratch.save(roots, f"{name}/roots")
    scratch.drop(*(f"{name}/step-{k}" for k in range(len(steps))))
    return roots


#: All rows of a bucket are leaders once the pairs across components are no more than so many times the rows there were:
#: places in prefixes sift pairs before they are compared.
SIFTED_PER_ROW = 16
#: Members, and leaders, of a bucket that are compared under one key.
CELL = 4096
#: Rows of a bucket that are ranked at a time to lead it.
RANKED = 341


def _pairs_left(rows: DataFrame) -> int:
    """Pairs of rows of one bucket with different roots."""
    sizes = rows.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    return sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0


def meeting(rows: DataFrame, lead: DataFrame, whole: bool) -> DataFrame:
    """Pairs of a member (bucket, id, .., size) and a leader (bucket, to, .., size) of one bucket with `size` rows; each pair once. `whole`: there may be as many leaders as members."""
    cells = F.ceil(F.col("size") / CELL).cast("int")
    others = cells if whole else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda c, n: F.pmod(F.xxhash64(F.lit(17), c), n).cast("int")
    left = rows.withColumn("cell", own("id", cells)).withColumn("cell2", every(others))
    right = lead.withColumn("cell2", own("to", others)).withColumn("cell", every(cells)).drop("size")
    return left.join(right.hint("merge"), ["bucket", "cell", "cell2"])


def linked(
    live: DataFrame, alike: Callable[[DataFrame], DataFrame], may_link: Callable[[Column, Column], Column], scratch: Scratch, first: Column | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, refine_after: int = 2, per_row: int | None = None
) -> DataFrame:
    """All (id, root) of ids that are linked to another.

    `live` has (bucket, id, x): an id stands in several buckets, x is what `may_link` looks at before a pair
    is compared. `alike` keeps those of its pairs (a, b) that are alike. Ids are linked when some bucket holds
    both, `may_link` allows it and they are alike; the components of these links are returned. Rows with the
    least `first` lead a bucket first, then those with the least hash. After `refine_after` rounds `refine` gives other
    buckets for the ids (id) that are left: any rows (bucket, id, x) that keep all alike ids together. Before that, not all are leaders, since
    nothing sifts their pairs. `per_row` takes the place of SIFTED_PER_ROW, where `may_link` sifts better than that.
    """
    rank = F.struct(F.lit(0) if first is None else first, F.xxhash64(F.lit(7), "id"), F.col("id"))

    def placed(rows: DataFrame, name: str) -> DataFrame:
        """Rows with their place in the order of their bucket, a large number beyond the first RANKED, so that no bucket is sorted whole."""
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
        top = rows.withColumn("place", place).filter(F.col("place") <= RANKED).select("bucket", "id", "place")
        out = rows.join(top.hint("merge"), ["bucket", "id"], "left").withColumn("place", F.coalesce("place", F.lit(1 << 30)))
        return scratch.save(out, name)

    placed_in = "placed"
    rows = placed(live.withColumn("rank", rank), placed_in)
    n_rows = rows.count()
    roots: DataFrame | None = None
    held = ""  # what `roots` is read from
    tried: list[str] = []
    k, low, high = 0, 0, 1
    while True:
        if roots is None:
            rows = rows.withColumn("root", F.col("id"))
        else:
            rows = rows.drop("root").join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size")
        rows = scratch.save(rows.drop("size").join(mixed.hint("merge"), "bucket").select("bucket", "id", "x", "rank", "place", "root", "size"), f"mixed-{k}")
        scratch.drop(f"mixed-{k - 1}", placed_in)
        if rows.isEmpty():
            break
        whole = k >= 2 and refine is None and _pairs_left(rows) <= n_rows * (per_row or SIFTED_PER_ROW)
        if not whole and (high > RANKED or refine is not None and k >= refine_after):
            again = rows.drop("place", "root", "size") if refine is None else refine(rows.select("id").distinct()).withColumn("rank", rank)
            placed_in = f"placed-{k}"
            rows = placed(again, placed_in)
            if refine is not None:
                n_rows = max(n_rows, rows.count())
            refine, k, low, high = None, k + 1, 0, 16
            continue
        lead = rows if whole else rows.filter((F.col("place") > low) & (F.col("place") <= high))
        lead = lead.select("bucket", F.col("id").alias("to"), F.col("x").alias("y"), F.col("root").alias("root2"), F.col("rank").alias("rank2"), "size")
        pairs = meeting(rows, lead, whole).filter((F.col("root") != F.col("root2")) & (F.col("rank") > F.col("rank2")) & may_link(F.col("x"), F.col("y")))
        pairs = pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), F.least("root", "root2").alias("root_a"), F.greatest("root", "root2").alias("root_b")).distinct()
        if tried:
            pairs = pairs.join(scratch.spark.read.schema("a long, b long").parquet(*tried).hint("merge"), ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{k}")
        if pairs.isEmpty():
            scratch.drop(f"pairs-{k}")
        else:
            tried.append(scratch.path(f"pairs-{k}"))
            links = alike(pairs.select("a", "b"))
            edges = pairs.join(links.hint("merge"), ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            moves = components(edges, scratch, f"components-{k}")
            if roots is None and not moves.isEmpty():
                roots, held = moves, f"components-{k}"
            elif roots is not None and not moves.isEmpty():
                moved = roots.join(moves.toDF("root", "next").hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
                fresh = moves.join(roots.select("id").hint("merge"), "id", "left_anti").select("id", "root")
                roots = scratch.save(moved.unionAll(fresh), f"roots-{k}")
                scratch.drop(held, f"components-{k}")
                held = f"roots-{k}"
        if whole:
            break
        rows = rows.filter(F.col("place") > high)
        k, low, high = k + 1, high, 4 * high + 1
    scratch.drop(f"mixed-{k}", *(f"pairs-{j}" for j in range(k + 1)))
    return scratch.spark.createDataFrame([], "id long, root long") if roots is None else roots
