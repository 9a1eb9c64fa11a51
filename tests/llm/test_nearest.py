"""Nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import nearest
from quern.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k=5):
    """The k nearest of each asked row, from distinct (id, vector) pairs; ties to the smaller id."""
    rows = sorted({(i, tuple(v)) for i, v in rows}, key=lambda r: r[0])
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for i, v in {(i, tuple(v)) for i, v in asked}:
        q = np.array(v, np.float64)
        score = (x * q).sum(1) / (norms * np.sqrt((q * q).sum()))
        order = [j for j in np.lexsort((ids, -score)) if rows[j] != (i, v)][:k]
        out.setdefault(i, []).append([(int(ids[j]), float(score[j])) for j in order])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({x[0] for x in got.get(q, [])} & {x[0] for x in one}) for q, (one,) in want.items()) / sum(len(one) for (one,) in want.values())


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    df = nearest.op11_nearest_neighbours(spark, sf)
    got = found(df)
    assert recall(got, want) >= 0.9
    for q, (one,) in want.items():
        assert len(got[q]) == 5 and [x[1] for x in got[q]] == sorted((x[1] for x in got[q]), reverse=True)
        assert all(score == dict(one)[i] for i, score in got[q] if i in dict(one))
    assert sorted(r["rank"] for r in df.filter("query_id = 0").collect()) == [1, 2, 3, 4, 5]


def test_clusters_and_copies(spark):
    """A third of all rows are copies of one vector, a third are close to another; parts of lists and batches of queries are cut small."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2, 24)).astype(np.float32)
    rows = [(k, (base[0] if k % 3 == 0 else base[1] + 0.05 * rng.standard_normal(24) if k % 3 == 1 else rng.standard_normal(24)).astype(np.float32).tolist()) for k in range(3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nearest, "PART_ROWS", 200)
        m.setattr(nearest, "BLOCK_ROWS", 37)
        m.setattr(nearest, "BATCH_ROWS", 5)
        got = found(nearest.nearest(df, df.filter("vec_id % 20 = 0")))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert recall(got, want) >= 0.95
    copies = [q for q in want if q % 3 == 0]
    for q in copies:
        assert [x[0] for x in got[q]] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5] == [x[0] for x in want[q][0]]


def test_odd_vectors(spark):
    """Nulls, NaN, infinities, zeros, other lengths and null ids take no part; repeated rows are one; one id with two vectors is two rows."""
    v = [1.0, 2.0, 0.5]
    rows = [(0, v, 1), (0, v, 1), (1, [2.0, 4.0, 1.0], 1), (2, None, 1), (50, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 2.0], 1), (4, [math.nan, 1.0, 1.0], 1), (5, [math.inf, 1.0, 1.0], 1), (6, [], 1), (100, [1.0, 1.0], 1), (None, v, 1), (7, [-1.0, -2.0, -0.5], 1), (150, [3.0, 0.0, 0.0], 1), (150, [0.0, 3.0, 0.0], 1), (8, [-0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("query_id", "rank", "score", "cid", "list", "ids", "part")})
    got = {}
    for r in sorted(nearest.nearest(df, df.filter("vec_id % 50 = 0")).collect()):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, x) for i, x, _ in rows if i in (0, 1, 7, 8, 150)]
    want = brute(usable, [r for r in usable if r[0] % 50 == 0])
    assert set(got) == {0, 150}
    assert [x[1] for x in got[0]] == [x[0] for x in want[0][0]] and len(got[0]) == 5
    assert sorted(got[150]) == sorted((k + 1, i, s) for one in want[150] for k, (i, s) in enumerate(one))
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0
    alone = df.filter("vec_id = 1")
    assert nearest.nearest(alone, alone).count() == 0 and nearest.nearest(df.filter("vec_id in (0, 1)"), alone).collect()[0].vec_id == 0


def test_queries_from_outside(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(16).tolist(), 0) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    other = spark.createDataFrame([(10_000 + k, rng.standard_normal(16).tolist(), 0) for k in range(20)], SCHEMA.replace("float", "double"))
    got = found(nearest.nearest(df, other, k=3))
    asked = [(r.vec_id, r.embedding) for r in other.collect()]
    assert recall(got, brute([(i, v) for i, v, _ in rows], asked, 3)) >= 0.9 and all(len(x) == 3 for x in got.values())


def test_abandoning_scan():
    """The tests abandon most of what is compared, and few that are near; at the last column the test is exact."""
    rng = np.random.default_rng(1)
    dims, n = 128, 4000
    x = nearest.unit(rng.standard_normal((n, dims)) * np.exp(rng.standard_normal(dims)))
    rotation = nearest.fit(x[:500], n).rotation
    turned = (x @ rotation).astype(np.float32)
    queries, bound = turned[:50], np.full(50, 0.0)
    d = 2 - 2 * x[:50] @ x.T
    bound = np.sort(d, 1)[:, 20]
    columns = [turned[:, c : c + 16] for c in range(0, dims, 16)]
    q, c, compared = nearest.abandoning_scan(queries, columns, dims, bound)
    want = {(i, j) for i in range(50) for j in np.flatnonzero(d[i] <= bound[i] - 1e-4)}
    got = set(zip(q.tolist(), c.tolist(), strict=True))
    assert len(want & got) >= 0.98 * len(want) and all(d[i, j] <= bound[i] + 1e-3 for i, j in got)
    assert compared < 0.5 * 50 * n * dims


def test_lists_hold_every_row(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("cid"), "embedding", F.col("vec_id").alias("least"))
    index = nearest.NearestIndex(df, 64, Scratch(spark, "index"))
    ids = np.concatenate([np.frombuffer(r.ids, np.int64)[::2] for r in index.blocks.select("ids").collect()])
    assert sorted(ids) == sorted(r.cid for r in df.select("cid").collect())
    assert index.blocks.agg(F.max("size")).first()[0] <= nearest.BLOCK_ROWS
