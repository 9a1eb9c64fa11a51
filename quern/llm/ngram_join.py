"""Exact Jaccard join of documents over 5-word shingles, by prefixes under several global orders.

Two sets of sizes n and m with Jaccard similarity 0.8 share at least 4 (n + m) / 9 tokens. Under any total
order of all tokens, the first n - 4 (n + m) / 9 + 1 tokens of either therefore have one in common. That
holds under every order at once: a pair is a candidate by a shared prefix token of the first order; a short
array, the prefix under the second order, must agree as well before any text is moved, and the prefixes
under the third before the sets are compared in full.

Every order puts common tokens last, by a sketch of document counts over all documents (a table of fixed
size; a wrong count costs time, never a result), and differs from the others in a hash. Documents with
equal sets are one class; classes are linked by `similar.linked`, so groups of copies are never paired off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, chunks, fresh, how_common, mix, read, row_key, shingles, signed
from quern.llm.similar import linked

#: Counters of the sketch, in binary digits, and counters in one row of a task's part of it.
SKETCH_BITS, CHUNK = 18, 1 << 13
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
WIDTH = 5


def _marks(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of sets: `s` has the tokens of all rows in order, `n` each row's number of them."""
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    at = np.append(0, np.cumsum(n))
    return signed(mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size and fingerprint of its set. At the end, this task's part of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "key", "n", "cls", "part", "counts"]
    for batch in batches:
        sizes, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, starts in chunks(batch.column(2)):
            s, row = shingles(data, starts, WIDTH)
            rows = len(starts) - 1
            sketch += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            n = np.bincount(row, minlength=rows)
            sizes.append(n)
            marks.append(_marks(s, n))
        n = np.concatenate(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(np.concatenate(marks)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    for k in range(0, len(sketch), CHUNK):
        if sketch[k : k + CHUNK].any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k // CHUNK], pa.int32()), pa.array([sketch[k : k + CHUNK].tobytes()], pa.binary())], names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def ranks(s: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens under one global order: common ones (by level) last, ties by hash."""
    h = mix(s ^ np.uint64(ORDERS[order])) >> np.uint64(8)
    return h | level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)


def _levels(profiles: DataFrame) -> np.ndarray:
    """How common the tokens of each counter are (see `how_common`), 2 ** SKETCH_BITS numbers."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    parts = profiles.filter("part is not null").select("part", "counts")
    for part, counts in parts.repartition((1 << SKETCH_BITS) // CHUNK, "part").mapInArrow(_add_up, "part int, counts binary").collect():
        sketch[part * CHUNK : (part + 1) * CHUNK] += np.frombuffer(counts, np.int64)
    return how_common(sketch)


def _may_link(x: Column, y: Column) -> Column:
    """Sizes allow similarity 0.8, and the shared token lies in the prefixes that this pair of sizes needs."""
    need = F.ceil((x["n"] + y["n"]) * 4 / 9)
    return (x["n"] * 5 >= y["n"] * 4) & (y["n"] * 5 >= x["n"] * 4) & (x["pos"] + need <= x["n"]) & (y["pos"] + need <= y["n"])


def first_tokens(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The prefix of a set under the second order, as the upper 32 bits of the tokens' places, sorted and distinct."""
    r = np.unique((ranks(s, level, 1) >> np.uint64(32)).astype(np.uint32))
    return r[: len(s) - -(-4 * len(s) // 5) + 1]


def may_be_similar(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
    """Whether the prefixes of two sets (of sizes n and m) under the second order allow similarity 0.8.

    They must share a token. And up to the lesser of their last places both sets are known, so that differences
    there count against those that the pair may have in all. Places cut to 32 bits can hide differences, never add any.
    """
    need = -(-4 * (n + m) // 9)
    end = min(a[-1] if len(a) < n else 1 << 32, b[-1] if len(b) < m else 1 << 32)
    both = len(np.intersect1d(a, b, assume_unique=True))
    if not both:
        return False
    x, y = a[: np.searchsorted(a, end)], b[: np.searchsorted(b, end)]
    return len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= n + m - 2 * need


def similar_sets(a: np.ndarray, b: np.ndarray, level: np.ndarray) -> bool:
    """Whether two sets of tokens have Jaccard similarity 0.8: first the prefixes of the last orders, then the sets."""
    need = -(-4 * (len(a) + len(b)) // 9)
    if need > min(len(a), len(b)):
        return False
    for k in range(2, len(ORDERS)):
        first = [np.partition(r, p)[: p + 1] if p + 1 < len(r) else r for r, p in ((ranks(s, level, k), len(s) - need) for s in (a, b))]
        if not len(np.intersect1d(*first)):
            return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, root) of each row of (doc_id, text): its key, the size of its set, and its component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    all_rows = scratch.save(docs.mapInArrow(_profiles, "doc_id long, key long, n long, cls long, part int, counts binary"), "profiles")
    profiles = all_rows.filter("part is null").select("doc_id", "key", "n", "cls")
    shared = spark.sparkContext.broadcast(_levels(all_rows))  # 256 kB, whatever the corpus

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for _, _, data, starts in chunks(batch.column(0)):
                s, row = shingles(data, starts, WIDTH)
                rows = len(starts) - 1
                n = np.bincount(row, minlength=rows)
                at = np.append(0, np.cumsum(n))
                cls = _marks(s, n)
                order = np.lexsort((ranks(s, level, 0), row))
                pos = np.arange(len(s)) - at[row]
                first = pos <= n[row] - -(-4 * n[row] // 5)
                yield pa.RecordBatch.from_arrays([pa.array(signed(s[order][first])), pa.array(cls[row[first]]), pa.array(n[row[first]].astype(np.int32)), pa.array(pos[first].astype(np.int32))], ["bucket", "id", "n", "pos"])

    rows = scratch.save(docs.select("text").mapInArrow(prefixes, "bucket long, id long, n int, pos int"), "prefixes")
    shared_tokens = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket")
    shared_tokens = scratch.save(shared_tokens, "tokens")
    live = rows.join(shared_tokens, "bucket").groupBy("bucket", "id").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    live = scratch.save(live.select("bucket", "id", F.struct("n", "pos").alias("x")), "live")
    scratch.drop("prefixes", "tokens")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and second prefix of a text of each class."""
        level, seen = shared.value, set()
        for batch in batches:
            for begin, last, data, starts in chunks(batch.column(1)):
                s, row = shingles(data, starts, WIDTH)
                n = np.bincount(row, minlength=len(starts) - 1)
                sets = np.split(s, np.cumsum(n)[:-1])
                marks = _marks(s, n).tolist()
                part = batch.slice(begin, last - begin)
                own = [k for k, (i, mark) in enumerate(zip(part.column(0).to_pylist(), marks, strict=True)) if i == mark and not (mark in seen or seen.add(mark))]
                yield pa.RecordBatch.from_arrays([pa.array([marks[k] for k in own], pa.int64()), pa.array(n[own].astype(np.int32)), pa.array([first_tokens(sets[k], level).tobytes() for k in own], pa.binary()), part.column(1).take(pa.array(own, pa.int64()))], ["id", "n", "first", "text"])

    needed = profiles.join(live.select(F.col("id").alias("cls")).distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key"))
    texts = docs.select("key", "text").join(needed.hint("merge"), "key").select(F.col("cls").alias("id"), "text")
    texts = scratch.save(texts.mapInArrow(describe, "id long, n int, first binary, text string").dropDuplicates(["id"]), "texts")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [may_be_similar(np.frombuffer(p, np.uint32), i, np.frombuffer(q, np.uint32), j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            sets = []
            for column in (2, 3):
                each = []
                for _, _, data, starts in chunks(batch.column(column)):
                    s, row = shingles(data, starts, WIDTH)
                    each += np.split(s, np.searchsorted(row, np.arange(1, len(starts) - 1)))
                sets.append(each)
            keep = [similar_sets(a, b, level) for a, b in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    tries = [0]

    def alike(pairs: DataFrame) -> DataFrame:
        sizes = texts.select("id", "n", "first")
        both = pairs.join(sizes.toDF("a", "n", "x").hint("merge"), "a").join(sizes.toDF("b", "m", "y").hint("merge"), "b")
        tries[0] += 1
        left = scratch.save(both.select("a", "b", "n", "m", "x", "y").mapInArrow(sift, "a long, b long"), f"sifted-{tries[0]}")
        whole = texts.select("id", "text")
        both = left.join(whole.toDF("a", "text_a").hint("merge"), "a").join(whole.toDF("b", "text_b").hint("merge"), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")

    # the document with the fewest tokens of its own before the shared one is the likeliest centre of a group
    roots = linked(live, alike, _may_link, scratch, first=F.col("x.pos"))
    scratch.drop("live", "texts")
    shared.destroy()
    return profiles.join(roots.toDF("cls", "root").hint("merge"), "cls", "left").select("doc_id", "key", "n", F.coalesce("root", "cls").alias("root"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """Class of each document (doc_id, text): doc_id, n_shingles, component_id (the least doc_id of its component).

    Words stand between ASCII white space, A-Z in lower case. A text of one to four words is one shingle; one
    without words (or null) has none and is linked with nothing. A document without an id links others like any; a
    component of such documents alone has a null component_id. Repeated doc_ids give a row each. An empty
    table gives an empty result. Other columns are ignored. Classes are known by 64-bit fingerprints.
    """
    placed = _placed(docs)
    least = placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each group of near-duplicates, with its columns unchanged.

    First is by doc_id (null last), then by a hash of id and text: rows of one doc_id with different texts are different
    documents. A row given twice (doc_id and text) stays once. Texts without words (null ones as well) stay. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "one_of_each")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.col("key"))
    placed = scratch.save(_placed(docs).filter("n > 0").groupBy("root", "doc_id", "key").count().withColumn("place", place), "placed")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    extra = scratch.save(placed.join(first.hint("merge"), "root").filter("place <> first").select("key").distinct(), "extra")
    twice = scratch.save(placed.filter("count > 1").join(extra.hint("merge"), "key", "left_anti").select("key"), "twice")
    key = fresh(docs, "__key")
    kept = docs.withColumn(key, row_key()).join(extra.toDF(key), key, "left_anti")
    if not twice.isEmpty():
        twice = twice.toDF(key)
        kept = kept.join(twice, key, "left_anti").unionAll(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))
