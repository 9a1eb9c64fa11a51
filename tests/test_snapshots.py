"""Versions of tables that share partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.sources.publication import PublicationError
from quern.sources.snapshots import Conflict, Snapshots


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), ["id"], parts=16)
    with pytest.raises(PublicationError):
        t.read()
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    assert t.create(df) == 0 and rows(t.read()) == [(k, 2 * k) for k in range(1000)]
    before = t.folders()
    assert t.change(spark.createDataFrame([(7, 0), (5000, 1)], "id long, v long"), spark.createDataFrame([(9,)], "id long")) == 1
    after = t.folders()
    changed = {p for p in after if after[p] != before.get(p)}
    assert 1 <= len(changed) <= 3 and set(before) <= set(after)
    want = [(k, 0 if k == 7 else 2 * k) for k in range(1000) if k != 9] + [(5000, 1)]
    assert rows(t.read()) == want and rows(t.read(0)) == [(k, 2 * k) for k in range(1000)]
    assert t.change(gone=spark.createDataFrame([], "id long")) == 1
    assert t.forget() >= 1 and rows(t.read()) == want
    with pytest.raises(PublicationError):
        t.read(0)


def test_two_writers(spark, tmp_path):
    """Of two writers of one version, one is told to begin again; readers see the other's."""
    t = Snapshots(spark, str(tmp_path / "t"), ["id"], parts=4)
    t.create(spark.range(10))
    with pytest.raises(Conflict):
        t.create(spark.range(3))
    late = Snapshots(spark, str(tmp_path / "t"), ["id"], parts=4)
    now, folders = late.version(), late.folders()
    t.change(gone=spark.createDataFrame([(3,)], "id long"))
    late.version, late.folders = (lambda: now), (lambda version=None: folders)
    with pytest.raises(Conflict):
        late.change(gone=spark.createDataFrame([(4,)], "id long"))
    assert [r.id for r in t.read().orderBy("id").collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_all_rows_may_go(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), ["id"], parts=4)
    t.create(spark.range(5).withColumn("s", F.lit("x")))
    t.change(gone=spark.range(5))
    assert t.read().count() == 0 and t.read().columns == ["id", "s"]
    t.change(spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "id long, s string"))
    assert t.read().count() == 3
