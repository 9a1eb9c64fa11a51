"""Checks over a catalogue of pipelines given as tables: nodes (pipeline, node_id) and edges (pipeline, src, dst, kind, boundary)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.operators.reach import endless_nodes
from quern.sources.shared import Scratch

RESERVED = "__quern_"
#: Edges of a pipeline up to which a task looks for its cycles by itself, and edges that a task looks at together.
SMALL, BLOCK = 1024, 1 << 16


def faults(nodes: DataFrame, edges: DataFrame, pipeline: str = "pipeline_id", reserved: str = RESERVED) -> DataFrame:
    """(pipeline, fault, subject) of each faulty node and edge, without cycles (see `cyclic_nodes`)."""
    p = F.col(pipeline)

    def row(df: DataFrame, fault: str, subject) -> DataFrame:
        return df.select(p, F.lit(fault).alias("fault"), subject.cast("string").alias("subject"))

    edge = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
    ids = nodes.select(pipeline, "node_id").distinct()
    ends = edges.join(ids.select(pipeline, F.col("node_id").alias("src"), F.lit(True).alias("has_src")), [pipeline, "src"], "left")
    ends = ends.join(ids.select(pipeline, F.col("node_id").alias("dst"), F.lit(True).alias("has_dst")), [pipeline, "dst"], "left")
    parts = [
        row(nodes.groupBy(pipeline, "node_id").count().filter("count > 1"), "duplicate node", F.col("node_id")),
        row(ids.filter(F.col("node_id").cast("string").startswith(reserved)), "reserved name", F.col("node_id")),
        row(ends.filter("has_src is null or has_dst is null").select(pipeline, "src", "dst").distinct(), "unknown node", edge),
        row(edges.filter("src = dst").select(pipeline, "src", "dst").distinct(), "self edge", edge),
        row(edges.groupBy(pipeline, "src", "dst", "kind").count().filter("count > 1").select(pipeline, "src", "dst").distinct(), "repeated edge", edge),
        row(edges.filter("kind = 'control' and boundary = 'checkpoint'").select(pipeline, "src", "dst").distinct(), "checkpoint on control edge", edge),
        row(edges.filter("kind = 'data'").select(pipeline, "src", "dst").groupBy(pipeline, "dst").count().filter("count > 1"), "fan-in", F.col("dst")),
    ]
    return reduce(DataFrame.unionAll, parts)


def _kept(pipeline: pa.Array, src: pa.Array, dst: pa.Array) -> np.ndarray:
    """Which edges of whole pipelines go on for ever both ways: those whose source has no edge in, or whose target has none out, are taken off until none is left."""
    group = pc.dictionary_encode(pipeline).indices.to_numpy().astype(np.int64)
    node = pc.dictionary_encode(pa.concat_arrays([src, dst])).indices.to_numpy().astype(np.int64)
    _, ids = np.unique(np.concatenate([group, group]) * len(node) + node, return_inverse=True)
    a, b = np.split(ids, 2)
    left = np.arange(len(a))
    while len(left):
        into, out = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        into[b[left]], out[a[left]] = True, True
        stay = left[into[a[left]] & out[b[left]]]
        if len(stay) == len(left):
            break
        left = stay
    return left


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order of pipelines: the sources of edges that stay; for a pipeline of more than SMALL edges one row without a node."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        p, src, dst = (t.column(k).combine_chunks() for k in range(3))
        left = pa.array(_kept(p, src, dst))
        return pa.RecordBatch.from_arrays([p.take(left), src.take(left)], names)

    names: list[str] = []
    held: pa.Table | None = None  # of its last pipeline, no more than is needed to know that it is large
    for batch in batches:
        names = [batch.schema.names[0], "node"]
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < BLOCK:
            continue
        held = held.combine_chunks()
        p = held.column(0).combine_chunks()
        starts = np.append(0, np.flatnonzero(pc.not_equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False)) + 1)
        yield from _sized(held.slice(0, starts[-1]), starts[:-1], solved, names)
        held = held.slice(starts[-1], SMALL + 1)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        p = held.column(0).combine_chunks()
        starts = np.append(0, np.flatnonzero(pc.not_equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False)) + 1)
        yield from _sized(held, starts, solved, names)


def _sized(t: pa.Table, starts: np.ndarray, solved: Callable[[pa.Table], pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """`solved` of the pipelines of at most SMALL edges, and a row for each other one."""
    if not t.num_rows:
        return
    sizes = np.diff(np.append(starts, t.num_rows))
    large = t.take(pa.array(starts[sizes > SMALL]))
    if large.num_rows:
        yield pa.RecordBatch.from_arrays([large.column(0).combine_chunks(), pa.nulls(large.num_rows, t.schema.types[1])], names)
        t = t.filter(pa.array(np.repeat(sizes <= SMALL, sizes)))
    if t.num_rows:
        yield solved(t)


def cyclic_nodes(edges: DataFrame, pipeline: str = "pipeline_id") -> DataFrame:
    """(pipeline, node) of nodes that lie on a cycle or between cycles, self edges included.

    These are the nodes from which edges go on for ever both ways. Pipelines of up to SMALL edges are dealt out whole, and a task looks at many of them together.
    Of larger ones, the nodes that go on backwards come first; of the nodes that are left, which are few if the
    pipelines are sound, forwards. Rounds don't grow with the longest chain (see `quern.operators.reach`).
    """
    wide = edges.select("src").union(edges.select("dst")).schema["src"].dataType
    known = edges.dropna(subset=[pipeline, "src", "dst"]).select(pipeline, F.col("src").cast(wide).alias("src"), F.col("dst").cast(wide).alias("dst"))
    schema = StructType([StructField(pipeline, edges.schema[pipeline].dataType), StructField("node", wide)])
    scratch = Scratch(edges.sparkSession, "cycles")
    found = scratch.save(known.repartition(pipeline).sortWithinPartitions(pipeline).mapInArrow(_solve, schema), "found")
    small = found.filter("node is not null").distinct()
    large = found.filter("node is null").select(pipeline)
    if not large.isEmpty():
        known = known.join(large, pipeline, "left_semi")
        back = endless_nodes(known.select(pipeline, F.col("dst").alias("node"), F.col("src").alias("on")), pipeline)
        left = known.select(pipeline, F.col("src").alias("node"), F.col("dst").alias("on"))
        left = left.join(back, [pipeline, "node"], "left_semi").join(back.withColumnRenamed("node", "on"), [pipeline, "on"], "left_semi")
        small = small.unionAll(endless_nodes(left, pipeline))
    return small.select(pipeline, F.col("node").cast(edges.schema["src"].dataType).alias("node"))
