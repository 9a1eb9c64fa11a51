"""Batch functions, row filters, sinks, boundaries, documents of pipelines and publication."""

from __future__ import annotations

import json
import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.operators.batches import filter_rows, map_batches
from quern.plans import declarative
from quern.queries import pipeline_q
from quern.sources import publication
from quern.sources.parquet import read_parquet, write_parquet


@pytest.fixture
def seed(spark, tmp_path):
    """256 rows of value and group."""
    path = str(tmp_path / "seed")
    spark.range(256).select(F.col("id").alias("value"), (F.col("id") % 8).alias("group")).write.parquet(path)
    return path


def test_batch_sizes(spark):
    def size(t: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([t.num_rows])})

    sizes = [r.n for r in map_batches(spark.range(0, 1000, numPartitions=1), size, "n long", batch_size=300, batch_format="arrow").collect()]
    assert sizes == [300, 300, 300, 100]
    with pytest.raises(ValueError):
        map_batches(spark.range(1), size, "n long", batch_size=0)


def test_rows_and_columns_may_change(spark):
    def twice(b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([b, b]).rename(columns={"id": "x"})

    assert map_batches(spark.range(5), twice, "x long").count() == 10
    assert map_batches(spark.range(5), lambda b: b[:0].rename(columns={"id": "x"}), "x long").count() == 0


def test_class_is_built_once_a_task(spark):
    class Counter:
        def __init__(self, start: int):
            self.n = start

        def __call__(self, b: pd.DataFrame) -> pd.DataFrame:
            self.n += 1
            return pd.DataFrame({"n": [self.n]})

    rows = map_batches(spark.range(0, 30, numPartitions=1), Counter, "n long", batch_size=10, fn_constructor_kwargs={"start": 5}).collect()
    assert [r.n for r in rows] == [6, 7, 8]


def test_filter_forms(spark, seed):
    df = read_parquet(spark, seed)
    assert filter_rows(df, "value < 10").count() == filter_rows(df, F.col("value") < 10).count() == 10
    assert filter_rows(df, lambda row, below: row["value"] < below, {"below": 10}).count() == 10


def test_expression_filters_reach_the_scan(spark, seed):
    plan = filter_rows(read_parquet(spark, seed, columns=["value"]), "value < 10")._jdf.queryExecution().toString()
    assert "LessThan(value,10)" in plan and "ReadSchema: struct<value:bigint>" in plan


def test_write_modes(spark, seed, tmp_path):
    out = str(tmp_path / "out")
    assert write_parquet(read_parquet(spark, seed), out).count() == 256
    with pytest.raises(AnalysisException):
        write_parquet(read_parquet(spark, seed), out)
    assert write_parquet(read_parquet(spark, seed), out, mode="overwrite", partition_by=["group"]).columns == ["value", "group"]


def test_document_with_fan_out_and_boundaries(spark, seed, tmp_path):
    base = str(tmp_path / "base")
    spec = {
        "nodes": [
            {"id": "read", "kind": "read_parquet", "config": {"path": seed}},
            {"id": "same", "kind": "map_batches", "config": {"fn": pipeline_q.identity, "batch_size": 256}},
            {"id": "a", "kind": "filter", "config": {"expr": "value < 100"}},
            {"id": "b", "kind": "filter", "config": {"fn": lambda row: row["value"] % 2 == 0}},
            {"id": "write", "kind": "write_parquet", "config": {"path": str(tmp_path / "out")}},
        ],
        "edges": [{"from": "read", "to": "same"}, {"from": "same", "to": "a"}, {"from": "same", "to": "b"}, {"from": "b", "to": "write", "boundary": "hard"}],
    }
    out = declarative.execute(spark, spec, base, "r")
    assert out["a"].count() == 100 and out["write"].count() == 128
    assert os.path.exists(f"{base}/runs/r/artifacts/same/committed/{publication.MARKER}")
    assert os.path.exists(f"{base}/runs/r/artifacts/b/committed/{publication.MARKER}")
    assert not os.path.exists(f"{base}/runs/r/artifacts/a")


@pytest.mark.parametrize("edges", [
    [("read", "map"), ("other", "map")],
    [("read", "map"), ("map", "map")],
    [("read", "map"), ("read", "gone")],
    [("read", "map"), ("read", "map")],
])
def test_faulty_documents(edges):
    nodes = [{"id": "read", "kind": "read_parquet"}, {"id": "other", "kind": "read_parquet"}, {"id": "map", "kind": "map_batches"}]
    with pytest.raises(declarative.PlanError):
        declarative.checked({"nodes": nodes, "edges": [{"from": a, "to": b} for a, b in edges]})


def test_more_faulty_documents():
    node = {"id": "x", "kind": "read_parquet"}
    for spec in (
        {"nodes": [node, node]},
        {"nodes": [{"id": "__quern_x", "kind": "read_parquet"}]},
        {"nodes": [{"id": "x", "kind": "join"}]},
        {"nodes": [{"id": "x", "kind": "filter"}]},
        {"nodes": [node, {"id": "y", "kind": "read_parquet"}], "edges": [{"from": "x", "to": "y", "kind": "control", "boundary": "checkpoint"}]},
        {"nodes": [node, {"id": "y", "kind": "read_parquet"}], "edges": [{"from": "x", "to": "y", "kind": "control"}, {"from": "y", "to": "x", "kind": "control"}]},
    ):
        with pytest.raises(declarative.PlanError):
            declarative.checked(spec)


def test_all_faults_at_once():
    """Faults don't hide one another."""
    spec = {
        "nodes": [{"id": "a", "kind": "read_parquet"}, {"id": "a", "kind": "read_parquet"}, {"id": "__quern_b", "kind": "join"}, {"id": "c", "kind": "filter"}, {"id": "d", "kind": "filter"}],
        "edges": [{"from": "a", "to": "gone"}, {"from": "c", "to": "d"}, {"from": "d", "to": "c"}, {"from": "c", "to": "d"}, {"from": "d", "to": "a", "kind": "control", "boundary": "checkpoint"}, {"from": "c", "to": "a"}],
    }
    found = declarative.faults(spec)
    assert all(found.values()) and found["repeated edges"] == [("c", "d", "data")] and set(found["cycles"][0]) == {"c", "d"}
    with pytest.raises(declarative.PlanError) as e:
        declarative.checked(spec)
    assert all(name in str(e.value) for name in found)
    fine = {"nodes": [{"id": i, "kind": k} for i, k in (("w", "write_parquet"), ("b", "read_parquet"), ("a", "filter"), ("c", "read_parquet"))], "edges": [{"from": "b", "to": "a"}, {"from": "a", "to": "w"}, {"from": "c", "to": "b", "kind": "control"}]}
    assert not any(declarative.faults(fine).values()) and declarative.checked(fine) == ["c", "b", "a", "w"]


def test_plans(spark, seed, tmp_path):
    read, some, write = {"id": "r", "kind": "read_parquet", "config": {"path": seed}}, {"id": "f", "kind": "filter", "config": {"expr": "value < 9"}}, {"id": "w", "kind": "write_parquet", "config": {"path": str(tmp_path / "out")}}
    assert declarative.execute(spark, declarative.plan_document([read, some, write]), str(tmp_path), "r")["w"].count() == 9
    for chain in ([], [read], [some, write], [read, some], [write, read]):
        with pytest.raises(declarative.PlanError):
            declarative.plan_document(chain)
    with pytest.raises(declarative.PlanError):
        declarative.checked(declarative.plan_document([read, {**some, "id": "r"}, write]))


def test_names_of_callables():
    assert declarative.resolve(declarative.callable_ref(pipeline_q.scale)) is pipeline_q.scale
    for fn in (lambda b: b, {}.get):
        with pytest.raises(declarative.PlanError):
            declarative.callable_ref(fn)
    for name in ("noname", "os.nothing_here", "no_such_module.f", "os.sep"):
        with pytest.raises(declarative.PlanError):
            declarative.resolve(name)


def test_publication(spark, tmp_path):
    base = str(tmp_path / "store")
    uri = publication.committed_path(base, "run 1", "a/b")
    assert uri.endswith("/runs/run 1/artifacts/a-b/committed")
    with pytest.raises(publication.PublicationError):
        publication.read_committed(spark, uri)
    with pytest.raises(ValueError):
        publication.staging_path(base, "r", "n", 0)
    staged = publication.stage(spark.range(100).repartition(3), base, "run 1", "a/b", 1)
    assert staged.endswith("/attempts/001/data")
    done = publication.commit(spark, staged, uri)
    marker = json.load(open(f"{uri}/{publication.MARKER}"))
    assert done.row_count == 100 and marker["content_hash"] == done.content_hash and list(marker) == sorted(marker)
    assert publication.read_committed(spark, uri).count() == 100
    with pytest.raises(publication.PublicationError):
        publication.commit(spark, staged, uri, file_format="csv")
    with pytest.raises(publication.PublicationError):
        publication.commit(spark, str(tmp_path / "nothing"), uri)
    # the first commit stays, unless it is to be replaced
    second = publication.stage(spark.range(7), base, "run 1", "a/b", 2)
    assert publication.commit(spark, second, uri) == done and publication.read_committed(spark, uri).count() == 100
    again = publication.commit(spark, second, uri, replace=True)
    assert again.row_count == publication.read_committed(spark, uri).count() == 7
    assert publication.clear_leftovers(spark, uri) == 1 and publication.read_committed(spark, uri).count() == 7


def _run(steps, n):
    """n steps of a commit; its result if it has ended."""
    for _ in range(n):
        try:
            next(steps)
        except StopIteration as e:
            return e.value
    return None


@pytest.mark.parametrize("before", range(6))
def test_two_commits_interleaved(spark, tmp_path, before):
    """One attempt does some steps, another some or all, then both end: one has won, its data is whole and both know it."""
    staged = [publication.stage(spark.range(n).coalesce(1), str(tmp_path), "r", "n", k + 1) for k, n in enumerate((10, 20))]
    for between in range(1, 6):
        uri = str(tmp_path / f"committed-{between}")
        one, two = (publication.committing(spark, s, uri) for s in staged)
        results = [_run(one, before), _run(two, between)]
        assert not publication.is_committed(spark, uri) or publication.read_committed(spark, uri).count() in (10, 20)
        results = [results[0] or _run(one, 9), results[1] or _run(two, 9)]
        first = 0 if before >= 4 or between < 4 else 1  # who came to the marker first
        assert results[0] == results[1] == publication.committed_as(spark, uri) and results[0].source == staged[first]
        assert publication.read_committed(spark, uri).count() == results[0].row_count == (10, 20)[first]
        assert sorted(os.listdir(uri)) == sorted([publication.MARKER, f".{publication.MARKER}.crc", results[0].folder]) or sorted(os.listdir(uri)) == sorted([publication.MARKER, results[0].folder])


def test_marker_is_made_once(spark, tmp_path):
    """Of many that create one file at once, one does, and the file is whole."""
    from concurrent.futures import ThreadPoolExecutor

    uri = str(tmp_path / "marker")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: publication.create_once(spark, uri, {"k": k}), range(40)))
    assert sum(made) == 1 and json.load(open(uri))["k"] == made.index(True)


def test_contents_are_identity(spark, tmp_path):
    """Files with the same names and sizes but another byte have another fingerprint; copies have the same."""
    uri = tmp_path / "data"
    spark.range(1000).repartition(5).write.parquet(str(uri))
    before = publication.fingerprint(publication.manifest(spark, str(uri)))
    assert before == publication.fingerprint(publication.manifest(spark, str(uri))) and before[2] == 5
    file = sorted(uri.glob("*.parquet"))[0]
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    for crc in uri.glob(".*.crc"):
        crc.unlink()
    after = publication.fingerprint(publication.manifest(spark, str(uri)))
    assert (before[0], before[2]) == (after[0], after[2]) and before[1] != after[1]


def test_rows_are_counted_while_written(spark, tmp_path):
    """The staged data is scanned for its bytes only; without the record of its rows it is counted."""
    staged = publication.stage(spark.range(50), str(tmp_path), "r", "n", 1)
    assert json.load(open(f"{staged}/{publication.STAGED}"))["rows"] == 50
    os.unlink(f"{staged}/{publication.STAGED}")
    assert publication.commit(spark, staged, str(tmp_path / "c")).row_count == 50


def test_deletion_stays_in_its_folder(spark, tmp_path):
    for name in ("a1", "a10"):
        spark.range(10).repartition(2).write.parquet(str(tmp_path / name))
    assert publication.delete_prefix(spark, str(tmp_path / "a1")) >= 2
    assert publication.delete_prefix(spark, str(tmp_path / "a1")) == 0
    assert spark.read.parquet(str(tmp_path / "a10")).count() == 10
    for root in ("/", "s3a://bucket", "s3a://bucket/", "file:///"):
        with pytest.raises(publication.PublicationError):
            publication.checked_prefix(root)


def test_addresses_of_object_stores(spark):
    """s3a addresses become Arrow's S3 file system, with the session's Hadoop settings."""
    from pyarrow import fs

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    settings = {"fs.s3a.access.key": "me", "fs.s3a.secret.key": "x", "fs.s3a.endpoint": "http://store:9000", "fs.s3a.endpoint.region": "us-east-1", "fs.s3a.path.style.access": "true"}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        options = publication.s3_options(spark)
    finally:
        for key in settings:
            conf.unset(key)
    assert options == {"access_key": "me", "secret_key": "x", "endpoint_override": "store:9000", "scheme": "http", "region": "us-east-1", "force_virtual_addressing": False}
    for scheme in ("s3", "s3a", "s3n"):
        system, path = publication._store(f"{scheme}://bucket/runs/1/part-0.parquet", options)
        assert isinstance(system, fs.S3FileSystem) and path == "bucket/runs/1/part-0.parquet"
    assert publication._store("file:/a/b c")[1] == publication._store("/a/b c")[1] == "/a/b c"


def test_control_edges_order_writes(spark, seed, tmp_path):
    first = str(tmp_path / "first")
    spec = {
        "nodes": [
            {"id": "z_read", "kind": "read_parquet", "config": {"path": seed}},
            {"id": "z_write", "kind": "write_parquet", "config": {"path": first}},
            {"id": "a_read", "kind": "read_parquet", "config": {"path": first}},
        ],
        "edges": [{"from": "z_read", "to": "z_write"}, {"from": "z_write", "to": "a_read", "kind": "control"}],
    }
    assert declarative.execute(spark, spec, str(tmp_path / "base"), "r")["a_read"].count() == 256
