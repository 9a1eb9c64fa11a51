"""Which nodes of a pipeline share one materialization segment.

Joins merge sorted rows, and none is broadcast: node tables have few bytes on disk, by which Spark judges them, but many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import Scratch


def starts_segment(edge_kind: Column, boundary: Column, parents: Column, siblings: Column, same_settings: Column) -> Column:
    """Whether a node starts a segment of its own: no single data parent, a boundary before it, a parent with several children, or other settings."""
    joined = (edge_kind == "data") & ~F.coalesce(boundary, F.lit("none")).isin("hard", "checkpoint") & (parents == 1) & (siblings == 1) & same_settings
    return ~F.coalesce(joined, F.lit(False))


def edge_parents(nodes: DataFrame, edges: DataFrame, settings: list[str], pipeline: str = "pipeline_id") -> DataFrame:
    """(pipeline, node, parent): the node that a node shares its segment with, null where it starts one."""
    data = edges.filter("kind = 'data'")
    parents = data.groupBy(pipeline, "dst").agg(F.count("*").alias("parents"))
    children = data.groupBy(pipeline, "src").agg(F.count("*").alias("siblings"))
    own = nodes.select(pipeline, F.col("node_id").alias("dst"), F.struct(*settings).alias("own"))
    above = nodes.select(pipeline, F.col("node_id").alias("src"), F.struct(*settings).alias("above"))
    e = data.join(parents.hint("merge"), [pipeline, "dst"]).join(own.hint("merge"), [pipeline, "dst"]).join(children.hint("merge"), [pipeline, "src"]).join(above.hint("merge"), [pipeline, "src"])
    e = e.filter(~starts_segment(F.col("kind"), F.col("boundary"), F.col("parents"), F.col("siblings"), F.col("own").eqNullSafe(F.col("above"))))
    linked = e.select(pipeline, F.col("dst").alias("node_id"), F.col("src").alias("parent"))
    return nodes.select(pipeline, "node_id").distinct().join(linked.hint("merge"), [pipeline, "node_id"], "left").select(pipeline, F.col("node_id").alias("node"), "parent")


def segments(links: DataFrame, pipeline: str = "pipeline_id") -> DataFrame:
    """(pipeline, node, segment): the first node of each node's segment, from (pipeline, node, parent or null); null for nodes on a cycle or below one.

    Pointer doubling: each round a node's pointer jumps to that of the node it points to, so a chain of n nodes
    takes log2(n) joins, and what points on after that is led by a cycle. A parent that is no node is a first node. Each round is written to the shared folder.
    """
    scratch = Scratch(links.sparkSession, "segments")
    at = scratch.save(links.select(pipeline, "node", F.coalesce("parent", "node").alias("segment"), F.col("parent").isNull().alias("done")), "round-0")
    longest = at.groupBy(pipeline).count().agg(F.max("count")).first()[0] or 1
    for k in range(1, longest.bit_length() + 2):
        if at.filter("not done").isEmpty():
            break
        up = at.select(pipeline, F.col("node").alias("segment"), F.col("segment").alias("next"), F.col("done").alias("there"))
        moved = at.join(up.hint("merge"), [pipeline, "segment"], "left").select(pipeline, "node", F.coalesce("next", "segment").alias("segment"), F.coalesce("there", F.lit(True)).alias("done"))
        at = scratch.save(moved, f"round-{k}")
        scratch.drop(f"round-{k - 1}")
    return at.select(pipeline, "node", F.when(F.col("done"), F.col("segment")).alias("segment"))


def segment_edges(found: DataFrame, edges: DataFrame, pipeline: str = "pipeline_id") -> DataFrame:
    """(pipeline, before, after): which segments must end before which begin."""
    a = found.select(pipeline, F.col("node").alias("src"), F.col("segment").alias("before"))
    b = found.select(pipeline, F.col("node").alias("dst"), F.col("segment").alias("after"))
    return edges.select(pipeline, "src", "dst").join(a.hint("merge"), [pipeline, "src"]).join(b.hint("merge"), [pipeline, "dst"]).filter("before <> after").select(pipeline, "before", "after").distinct()
