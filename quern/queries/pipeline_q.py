"""Queries for pipeline operators and dataset publication, and their SQL."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quern.operators.batches import filter_rows, map_batches
from quern.plans.declarative import callable_ref, execute, pipeline, resolve
from quern.queries.views import Registry, table
from quern.sources import publication
from quern.sources.parquet import read_parquet, write_parquet
from quern.sources.shared import Scratch

R = Registry({}, {})
LATE = "l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'"
CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def add_cents(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(cents=(batch["l_extendedprice"] * 100).round().astype("int64"))[["l_orderkey", "l_linenumber", "l_partkey", "cents"]]


def note_size(batch: pa.Table) -> pa.Table:
    return batch.select(["l_orderkey", "l_linenumber", "l_partkey"]).append_column("batch_rows", pa.array([batch.num_rows] * batch.num_rows, pa.int64()))


def scale(batch: pa.Table, factor: int, offset: int = 0) -> pa.Table:
    return pa.table({"l_orderkey": batch["l_orderkey"], "l_linenumber": batch["l_linenumber"], "scaled": pc.add(pc.multiply(pc.cast(batch["l_quantity"], pa.int64()), factor), offset)})


def is_large(row: dict) -> bool:
    return row["o_totalprice"] > 250_000 and row["o_orderstatus"] != "O"


def identity(batch: pd.DataFrame) -> pd.DataFrame:
    return batch


class LengthBands:
    """Words of a text by length; the table is built once in each task."""

    def __init__(self, bounds: tuple[int, ...] = (100, 1000, 10_000)):
        self.bounds = bounds

    def __call__(self, batch: pa.Table) -> pa.Table:
        sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
        return pa.table({"doc_id": batch["doc_id"], "band": pa.array([sum(n >= b for b in self.bounds) for n in sizes], pa.int32())})


CENT_SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, cents long"
SLICE = f"SELECT l_orderkey, l_linenumber, l_partkey, {CENTS} AS cents FROM lineitem WHERE {LATE}"


@R.add("a1_slice", SLICE)
def slice_(spark, d):
    """Read, filter, batch function, write, read back."""
    late = read_parquet(spark, f"{d}/lineitem.parquet", columns=COLUMNS).filter(LATE).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return write_parquet(map_batches(late, add_cents, CENT_SCHEMA), Scratch(spark, "slice").path("out"))


@R.add("a1_read_parquet", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem")
def a1(spark, d):
    return read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_shipdate", "l_quantity"], mergeSchema=False)


@R.add("a2_map_batches", f"SELECT l_orderkey, l_linenumber, l_partkey, {CENTS} AS cents FROM lineitem")
def a2(spark, d):
    return map_batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), add_cents, CENT_SCHEMA)


@R.add("a3_map_class", "SELECT doc_id, CAST((CASE WHEN n >= 100 THEN 1 ELSE 0 END) + (CASE WHEN n >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN n >= 10000 THEN 1 ELSE 0 END) AS INT) AS band FROM (SELECT doc_id, COALESCE(LENGTH(text), 0) AS n FROM documents) q")
def a3(spark, d):
    return map_batches(table(spark, d, "documents").select("doc_id", "text"), LengthBands, "doc_id long, band int", batch_format="arrow")


@R.add("a4_batch_size", "SELECT COUNT(*) AS n, CAST(1000 AS BIGINT) AS largest FROM lineitem")
def a4(spark, d):
    sized = map_batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), note_size, "l_orderkey long, l_linenumber int, l_partkey long, batch_rows long", batch_size=1000, batch_format="arrow")
    return sized.agg(F.count("*").alias("n"), F.max("batch_rows").alias("largest"))


@R.add("a5_fn_kwargs", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 3 + 7 AS scaled FROM lineitem")
def a5(spark, d):
    return map_batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), scale, "l_orderkey long, l_linenumber int, scaled long", batch_format="arrow", fn_kwargs={"factor": 3, "offset": 7})


@R.add("a6_filter_expression", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'O'")
def a6(spark, d):
    return filter_rows(table(spark, d, "orders"), (F.col("o_totalprice") > 250_000) & (F.col("o_orderstatus") != "O")).select("o_orderkey", "o_totalprice")


@R.add("a6_filter_function", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'O'")
def a6b(spark, d):
    return filter_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), is_large)


@R.add("a7_write_parquet", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders")
def a7(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return write_parquet(orders, Scratch(spark, "write").path("orders"), partition_by=["o_orderstatus"])


@R.add("a8_tee", f"SELECT l_orderkey, CAST(SUM(cents) AS BIGINT) AS cents FROM ({SLICE}) q GROUP BY l_orderkey")
def a8(spark, d):
    late = table(spark, d, "lineitem").filter(LATE).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    written = write_parquet(map_batches(late, add_cents, CENT_SCHEMA), Scratch(spark, "tee").path("late"))
    return written.groupBy("l_orderkey").agg(F.sum("cents").alias("cents"))


@R.add("a9_checkpoint", f"SELECT l_partkey, CAST(MAX(cents) AS BIGINT) AS top FROM ({SLICE}) q GROUP BY l_partkey")
def a9(spark, d):
    late = table(spark, d, "lineitem").filter(LATE).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    kept = publication.publish(map_batches(late, add_cents, CENT_SCHEMA), Scratch(spark, "checkpoint").base, "run-1", "late lines")
    return kept.groupBy("l_partkey").agg(F.max("cents").alias("top"))


@R.add("a12_fan_out", "SELECT 'status' AS side, o_orderstatus AS label, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority, COUNT(*) FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def a12(spark, d):
    shared = table(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    shared = publication.publish(shared, Scratch(spark, "fan_out").base, "run-1", "shared")
    one = shared.groupBy(F.lit("status").alias("side"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    return one.unionAll(shared.groupBy(F.lit("priority").alias("side"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n")))


@pipeline(name="late-lines")
def late_lines(lines, since: str):
    return lines.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").transform(map_batches, add_cents, CENT_SCHEMA)


@R.add("a14_pipeline_function", SLICE)
def a14(spark, d):
    return late_lines(table(spark, d, "lineitem"), since="1998-01-01 00:00:00")


def document(d: str, out: str) -> dict:
    """read > map > checkpoint > map > filter > write, with a control edge and a soft boundary."""
    cents = "l_orderkey long, l_linenumber int, l_partkey long, cents long"
    return {
        "name": "lines",
        "nodes": [
            {"id": "read", "kind": "read_parquet", "config": {"path": f"{d}/lineitem.parquet", "columns": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]}},
            {"id": "cents", "kind": "map_batches", "config": {"fn": callable_ref(add_cents), "schema": cents, "batch_size": 4096}},
            {"id": "same", "kind": "map_batches", "config": {"fn": callable_ref(identity), "schema": cents}},
            {"id": "large", "kind": "filter", "config": {"expr": "cents > 2000000"}},
            {"id": "write", "kind": "write_parquet", "config": {"path": out}},
        ],
        "edges": [
            {"from": "read", "to": "cents"},
            {"from": "cents", "to": "same", "boundary": "checkpoint"},
            {"from": "same", "to": "large", "boundary": "soft"},
            {"from": "large", "to": "write"},
            {"from": "read", "to": "write", "kind": "control"},
        ],
    }


@R.add("a15_declarative", f"SELECT l_orderkey, l_linenumber, l_partkey, {CENTS} AS cents FROM lineitem WHERE {CENTS} > 2000000")
def a15(spark, d):
    scratch = Scratch(spark, "declarative")
    return execute(spark, document(d, scratch.path("out")), scratch.base, "run-1")["write"]


@R.add("a10_hard_boundary", "SELECT o_orderkey, o_custkey, o_totalprice, TRUE AS published FROM orders WHERE o_totalprice > 150000")
def a10(spark, d):
    """A node before a hard boundary is published, and what follows reads the committed files."""
    scratch = Scratch(spark, "boundary")
    spec = {
        "nodes": [
            {"id": "read", "kind": "read_parquet", "config": {"path": f"{d}/orders.parquet", "columns": ["o_orderkey", "o_custkey", "o_totalprice"]}},
            {"id": "large", "kind": "filter", "config": {"expr": "o_totalprice > 150000"}},
            {"id": "write", "kind": "write_parquet", "config": {"path": scratch.path("out")}},
        ],
        "edges": [{"from": "read", "to": "large"}, {"from": "large", "to": "write", "boundary": "hard"}],
    }
    out = execute(spark, spec, scratch.base, "run-1")
    stable = publication.committed_path(scratch.base, "run-1", "large")
    return out["write"].join(publication.read_committed(spark, stable).select("o_orderkey").distinct(), "o_orderkey", "left_semi").withColumn("published", F.lit(publication.is_committed(spark, stable)))


@R.add("a13_control_order", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def a13(spark, d):
    """One branch reads what another has written: only the control edge, against the order of names, makes it wait."""
    scratch = Scratch(spark, "control")
    spec = {
        "nodes": [
            {"id": "z-read", "kind": "read_parquet", "config": {"path": f"{d}/orders.parquet", "columns": ["o_orderkey", "o_orderstatus"]}},
            {"id": "z-write", "kind": "write_parquet", "config": {"path": scratch.path("first")}},
            {"id": "a-read", "kind": "read_parquet", "config": {"path": scratch.path("first")}},
            {"id": "b-final", "kind": "filter", "config": {"expr": "o_orderstatus = 'F'"}},
            {"id": "c-write", "kind": "write_parquet", "config": {"path": scratch.path("second")}},
        ],
        "edges": [
            {"from": "z-read", "to": "z-write"},
            {"from": "z-write", "to": "a-read", "kind": "control"},
            {"from": "a-read", "to": "b-final"},
            {"from": "b-final", "to": "c-write"},
        ],
    }
    return execute(spark, spec, scratch.base, "run-1")["c-write"]


@R.add("a16_callable_by_name", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 2 AS scaled FROM lineitem")
def a16(spark, d):
    fn = resolve(callable_ref(scale))
    return map_batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), fn, "l_orderkey long, l_linenumber int, scaled long", batch_format="arrow", fn_kwargs={"factor": 2})


@R.add("b3_manifest", "SELECT DISTINCT CONCAT('o_orderstatus=', o_orderstatus) AS folder, 1 AS files, TRUE AS sized FROM orders")
def b3(spark, d):
    """The files of a dataset that is written as one file a folder, with their sizes; the marker isn't one of them."""
    uri = Scratch(spark, "manifest").path("orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(uri)
    files = publication.manifest(spark, uri).select(F.split_part("name", F.lit("/"), F.lit(1)).alias("folder"), "size")
    return files.groupBy("folder").agg(F.count("*").cast("int").alias("files"), (F.min("size") > 0).alias("sized"))


LINE = "CONCAT(CAST(o_orderkey AS STRING), '|', CAST(o_custkey AS STRING), '|', o_orderstatus, '|', o_orderpriority)"
FOLDER = "CAST(FLOOR(o_orderkey / 4000) AS BIGINT)"
CHANGED = f"CASE WHEN o_orderkey % 4000 < 100 AND {FOLDER} % 3 = 0 THEN CONCAT(SUBSTR({LINE}, 1, LENGTH({LINE}) - 1), '?') ELSE {LINE} END"


def lines_of_orders(spark, d, line: str, uri: str):
    """Orders as lines of text, one file for each 4000 keys, lines in order of keys; its manifest, with those keys in place of names."""
    rows = table(spark, d, "orders").selectExpr(f"{FOLDER} AS folder", "o_orderkey", f"{line} AS line")
    rows.repartition("folder").sortWithinPartitions("folder", "o_orderkey").drop("o_orderkey").write.partitionBy("folder").text(uri)
    return publication.manifest(spark, uri).withColumn("name", F.regexp_extract("name", r"folder=(\d+)/", 1))


@R.add("b3_content_digests", f"SELECT CAST({FOLDER} AS STRING) AS name, CAST(SUM(LENGTH({LINE}) + 1) AS BIGINT) AS size, SHA256(STRING_AGG(CONCAT({LINE}, CHR(10)), '' ORDER BY o_orderkey)) AS etag FROM orders GROUP BY {FOLDER}")
def b3_digests(spark, d):
    """The digest of each file of a dataset, from its bytes."""
    return lines_of_orders(spark, d, LINE, Scratch(spark, "digests").path("lines")).select("name", "size", "etag")


@R.add("b4_changed_bytes", f"SELECT name, same_size, before <> after AS changed, TRUE AS whole_differs, TRUE AS copy_agrees FROM (SELECT CAST({FOLDER} AS STRING) AS name, SHA256(STRING_AGG({LINE}, '' ORDER BY o_orderkey)) AS before, SHA256(STRING_AGG({CHANGED}, '' ORDER BY o_orderkey)) AS after, SUM(LENGTH({LINE})) = SUM(LENGTH({CHANGED})) AS same_size FROM orders GROUP BY {FOLDER}) q")
def b4_changed(spark, d):
    """Some bytes of some files are changed: which files differ, though names and sizes agree, and whether the fingerprint of all tells."""
    scratch = Scratch(spark, "changed")
    one, two, copy = (scratch.save(lines_of_orders(spark, d, line, scratch.path(name)), f"{name}-files") for name, line in (("one", LINE), ("two", CHANGED), ("copy", LINE)))
    prints = [publication.fingerprint(files)[1] for files in (one, two, copy)]
    both = one.join(two.select("name", F.col("size").alias("size2"), F.col("etag").alias("etag2")), "name")
    return both.select("name", (F.col("size") == F.col("size2")).alias("same_size"), (F.col("etag") != F.col("etag2")).alias("changed"), F.lit(prints[0] != prints[1]).alias("whole_differs"), F.lit(prints[0] == prints[2]).alias("copy_agrees"))


@R.add("b7_concurrent_attempts", "SELECT o_orderkey, o_custkey, 3 AS attempt FROM orders")
def b7_concurrent(spark, d):
    """Three attempts commit the same output, each step of one between steps of the others; the one that gets to the marker first wins, and all read its dataset."""
    base = Scratch(spark, "attempts").base
    uri = publication.committed_path(base, "run-1", "orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    steps = [publication.committing(spark, publication.stage(orders.withColumn("attempt", F.lit(k)), base, "run-1", "orders", k), uri) for k in (1, 2, 3)]
    for attempt, times in ((0, 2), (1, 3), (2, 2), (0, 1), (2, 9), (1, 9), (0, 9)):
        for _ in range(times):
            next(steps[attempt], None)
    return publication.read_committed(spark, uri)


@R.add("b9_delete_prefix", "SELECT o_orderstatus, COUNT(*) AS n, TRUE AS deleted, 0 AS again FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus")
def b9(spark, d):
    """One folder of a dataset is deleted; others stay, and a second deletion finds nothing."""
    uri = Scratch(spark, "delete").path("orders")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(uri)
    n = publication.delete_prefix(spark, f"{uri}/o_orderstatus=F")
    again = publication.delete_prefix(spark, f"{uri}/o_orderstatus=F")
    left = spark.read.parquet(uri).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return left.withColumns({"deleted": F.lit(n > 0), "again": F.lit(again).cast("int")})


@R.add("b5_published_size", "SELECT COUNT(*) AS row_count, CAST(7 AS INT) AS columns, TRUE AS committed FROM lineitem")
def b5(spark, d):
    """Stage, commit and read back; what the commit recorded, whose rows were counted as they were written."""
    base = Scratch(spark, "publish").base
    uri = publication.committed_path(base, "run-1", "lines")
    done = publication.commit(spark, publication.stage(table(spark, d, "lineitem").select(*COLUMNS), base, "run-1", "lines", 1), uri)
    lines = publication.read_committed(spark, uri)
    return lines.agg(F.count("*").alias("row_count")).filter(F.col("row_count") == done.row_count).select("row_count", F.lit(len(lines.columns)).alias("columns"), F.lit(publication.is_committed(spark, uri)).alias("committed"))


@R.add("b6_republished", f"SELECT l_orderkey, l_linenumber, l_partkey, {CENTS} AS cents FROM lineitem")
def b6(spark, d):
    """A later attempt doesn't replace what an earlier one committed."""
    base = Scratch(spark, "republish").base
    lines = map_batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), add_cents, CENT_SCHEMA)
    first = publication.publish(lines, base, "run-1", "lines", attempt=1)
    return publication.publish(first.filter("cents < 0"), base, "run-1", "lines", attempt=2)
