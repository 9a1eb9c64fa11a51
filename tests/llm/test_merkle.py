"""Manifests and proofs against a plain Merkle tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        begin = place // 16 * 16
        run = level[begin : begin + 16]
        out.append((run[: place - begin], run[place - begin + 1 :]))
        place //= 16
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0), leaf(row), row))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in sources}
    over = tree([trees[s][-1][0] for s in sources])
    out = []
    for ordinal, s in enumerate(sources):
        for place, (_, own, row) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            steps = path(trees[s], place) + path(over, ordinal)
            folded = own
            if zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in steps:
                folded = digest(*left, folded, *right)
            root = over[-1][0]
            out.append((row[0], own, trees[s][-1][0], root, digest(*(x for left, right in steps for x in (*left, *right))), folded, folded == root))
    return sorted(out, key=str)


def proofs(docs):
    return merkle.manifest(docs, COLUMNS, "source", "doc_id", [F.col("doc_id")])


def as_given(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_query_by_brute_force(spark, sf):
    got = sorted(map(tuple, merkle.op13_merkle_proofs(spark, sf).collect()), key=str)
    assert got == brute(as_given(spark.read.parquet(f"{sf}/documents.parquet")))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("sizes", [[1], [16], [17], [256], [257], [1, 2, 16, 17, 300], [1] * 40])
def test_sizes_of_groups(spark, documents, sizes):
    """Lone leaves, full runs, runs of one, and more groups than a node has children."""
    rows = [(k * 10_000 + j, f"text {k} {j}") for k, n in enumerate(sizes) for j in range(n)]
    docs = documents(rows).withColumn("source", F.concat(F.lit("s"), F.expr("doc_id div 10000")))
    m = proofs(docs)
    out = m.proofs().select("kept.doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("p"), merkle.fold(F.col("leaf"), F.col("path")).alias("f"))
    want = brute(as_given(docs))
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(w[:5] for w in want)
    assert all(r.f == m.root for r in out.collect())


def test_odd_rows(spark, documents, odd, tmp_path):
    """Nulls in every column, repeated rows, odd names of sources and clashing columns."""
    docs = documents(odd, extra=True).withColumn("source", F.expr("case when doc_id = 4 then null when doc_id = 5 then '' when doc_id = 6 then 'Ä' when doc_id = 7 then '\\uD83D\\uDE00' when doc_id < 4 then 'Z' else '\\uFFFD' end"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") != 9, F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") != 8, F.col("n_chars"))).withColumns({c: F.lit("x") for c in ("grp", "place", "digest", "kept", "path")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op13_merkle_proofs(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(as_given(docs)) and len(got) == len(odd)
    empty = proofs(documents([]))
    assert empty.root is None and empty.proofs().count() == 0 and empty.records().count() == 0


def test_row_given_many_times(spark, documents):
    """Copies of one row are leaves of their own, in nodes that share records."""
    docs = documents([*((7, "again") for _ in range(5000)), *((k, "other") for k in range(50))]).withColumn("source", F.lit("one")).withColumn("n_chars", F.lit(5).cast("long"))
    m = proofs(docs)
    out = m.proofs().select(F.col("leaf"), merkle.fold(F.col("leaf"), F.col("path")).alias("f"), merkle.path_digest(F.col("path")).alias("p"))
    want = brute(as_given(docs))
    assert sorted((r.leaf, r.p) for r in out.collect()) == sorted((w[1], w[4]) for w in want)
    assert {r.f for r in out.collect()} == {m.root} == {w[3] for w in want}
    assert m.records().count() < 60


def test_requests_and_store(spark, documents):
    """Some leaves only, by their digests; each record of the store hashes to its own digest, and leads down to leaves."""
    docs = documents([(k, f"t{k}") for k in range(700)])
    m = proofs(docs)
    everything = {r.kept.doc_id: r for r in m.proofs().collect()}
    few = spark.createDataFrame([(everything[k].leaf,) for k in (0, 3, 350, 699)] + [("unknown",)], "leaf string")
    assert {r.kept.doc_id: r for r in m.proofs(few).collect()} == {k: everything[k] for k in (0, 3, 350, 699)}
    store = {r.digest: r.children for r in m.records().collect()}
    assert all(digest(*children) == d and len(children) <= 16 for d, children in store.items())
    front, leaves = [m.root], set()
    while front:
        leaves |= {d for d in front if d not in store}
        front = [c for d in front for c in store.get(d, [])]
    assert leaves == {r.leaf for r in everything.values()}


def test_a_changed_row_changes_its_path_only(documents):
    """Records of what didn't change are the same in the next manifest."""
    one = proofs(documents([(k, f"t{k}") for k in range(600)]))
    two = proofs(documents([(k, f"t{k}" if k != 300 else "tX") for k in range(600)]))
    assert one.root != two.root
    assert 1 <= two.records().join(one.records(), "digest", "left_anti").count() <= 4
