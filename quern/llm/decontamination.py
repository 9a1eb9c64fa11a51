"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A seed is two words of a test item with at most one between them; a text has it if they occur there in this order, again with at most
one between. One pass over the texts finds seeds, cuts the passages around them and aligns each with its item by words, which scores edited
and paraphrased copies as well.

Nothing is lost by that. An alignment of M matches and E edits scores 2 M - E. Of the M - 1 steps from one match to the next, those with two edits or more
are E / 2 at most; each other step is a seed. With a score of s there are at least s / 2 - 1 seeds (at distinct words of the item), so a passage
with fewer is left out. As many of an item's seeds can be spared as half of that number, and those that most items have are: the seeds looked for are the
rarer ones, and a passage needs the other half of them. A passage is also left out if it holds so few of the item's words that no alignment can score enough.

The test items are the stated query set: they are read in blocks of bounded size, each one an index that
is broadcast and matched against all texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, chunks, fresh, mix, read, row_key, words

#: Bytes of test items in one block, on average.
BLOCK_BYTES = 16 << 20
MIN_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the best score an item can have, or least score whatever the item's length.
MIN_SHARE, MIN_SCORE = 0.4, 60
_MULT = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(2)], np.uint64)


def _seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of some words: fingerprint, and place of the first word."""
    pairs = [(h[:-k], h[k:]) for k in (1, 2) if len(h) > k]
    place = [np.arange(len(h) - k) for k in (1, 2) if len(h) > k]
    return np.concatenate([np.zeros(0, np.uint64), *(mix(a * _MULT[0] + b * _MULT[1]) for a, b in pairs)]), np.concatenate([np.zeros(0, np.int64), *place])


def _sure(m: int) -> int:
    """Seeds at distinct words that a copy of an item of m words has at least."""
    return max(1, -(-min(MIN_SCORE, int(np.ceil(MIN_SHARE * MATCH * m))) // 2) - 1)


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each run of `size` words."""
    n = max(len(h) - size + 1, 0)
    return mix(sum((h[j : j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(size)), np.zeros(n, np.uint64)))


class Index:
    """Seeds of one block of test items, as sorted arrays of some 40 bytes a word. Items of fewer than MIN_WORDS words are known by all their words."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        each = [(item, h) for item, text in items if len(h := item_words(text))]
        self.ids = [item for item, _ in each]
        self.at = np.cumsum([0, *(len(h) for _, h in each)])
        self.flat = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in each)])
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        seeds, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, (_, h) in enumerate(each):
            if len(h) < MIN_WORDS:
                self.short[len(h)][int(_windows(h, len(h))[0])].append(k)
            else:
                found, first = _seeds(h)
                seeds.append(found)
                place.append(first + (k << 32))
        self.short = {size: dict(x) for size, x in self.short.items()}
        found, where = np.concatenate(seeds), np.concatenate(place)
        kinds, number = np.unique(found, return_inverse=True)
        owners = np.unique(number * (1 << 24) + (where >> 32) % (1 << 24)) >> 24  # one for each seed and item
        common = np.bincount(owners, minlength=len(kinds))[number]
        sure = np.array([_sure(len(h)) for _, h in each] or [1])
        self.need = sure - sure // 2
        order = np.lexsort((found, -common, where >> 32))  # of each item, the most common seeds first
        item = where[order] >> 32
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank >= (sure // 2)[item]]
        kept = kept[np.argsort(found[kept], kind="stable")]
        self.seeds, self.place = found[kept], where[kept]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def words(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k + 1]]

    def passages(self, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Item, first word and words of each passage of a text that holds seeds. Seeds further apart than an item make several passages."""
        for size, known in self.short.items():
            keys, at = np.unique(_windows(h, size), return_index=True)
            for k in np.flatnonzero(np.isin(keys, np.fromiter(known, np.uint64, len(known)))).tolist():
                for item in known[int(keys[k])]:
                    yield item, int(at[k]), h[at[k] : at[k] + size]
        s, begin = _seeds(h)
        at = np.flatnonzero(self.bits[(s >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(self.seeds, s[at], "left")
        count = np.searchsorted(self.seeds, s[at], "right") - low
        where = self.place[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        hit, items, first = np.repeat(begin[at], count), where >> 32, where & 0xFFFFFFFF
        often = np.bincount(items, minlength=len(self.ids))[items] >= self.need[items] if len(items) else np.zeros(0, bool)
        hit, items, first = hit[often], items[often], first[often]
        order = np.lexsort((hit, items))
        for group in np.split(order, np.flatnonzero(np.diff(items[order])) + 1) if len(order) else ():
            item = int(items[group[0]])
            m = int(self.at[item + 1] - self.at[item])
            for part in np.split(group, np.flatnonzero(np.diff(hit[group]) > 3 * m) + 1):  # an alignment has no more than 1.2 m edits
                if len(part) >= self.need[item] and len(np.unique(first[part])) >= self.need[item]:
                    shift = hit[part] - first[part]
                    begin_at = max(0, int(shift.min()) - m - m // 4 - 1)
                    yield item, begin_at, h[begin_at : int(shift.max()) + 3 * m]


def enough(score: int, item: np.ndarray) -> bool:
    """Whether a score makes a passage a copy of the item."""
    return score >= MIN_SHARE * MATCH * len(item) or score >= MIN_SCORE


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences, and the aligned span of the passage."""
    n = len(passage)
    reach = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        score = np.where(passage == word, MATCH, MISMATCH)
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + score, row[1:] + GAP)
        start = np.arange(n + 1)
        start[1:] = np.where(row[:-1] + score >= row[1:] + GAP, begin[:-1], begin[1:])
        start = np.where(new > 0, start, np.arange(n + 1))
        new = np.maximum(new, 0)
        run = np.maximum.accumulate(new + reach)  # the best of all gaps along the passage
        moved = run - reach > new
        if moved.any():
            origin = np.maximum.accumulate(np.where(new + reach == run, np.arange(n + 1), 0))
            start = np.where(moved, start[origin], start)
            new = run - reach
        row, begin = new, start
        j = int(row.argmax())
        if row[j] > best:
            best, span = int(row[j]), (int(begin[j]), j)
    return best, *span


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    named = benchmark.filter("item_id is not null")
    benchmark = named.unionAll(benchmark.filter("item_id is null").distinct().join(named.select("text").distinct(), "text", "left_anti").select("item_id", "text"))
    n_bytes = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-n_bytes // BLOCK_BYTES))
    for k in range(n):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [(r[0], r[1]) for r in rows]


FOUND = "doc_id long, key long, item_id long, score long, share double, span_start long, span_end long"


def _scored(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Every passage that is a copy of a test item, with its row's key. One pass over the texts for each block of items."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(items))  # some 100 MB for a block of BLOCK_BYTES

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                ids, keys, index = batch.column(0), batch.column(1), shared.value
                for first, _, data, starts in chunks(batch.column(2)):
                    h, _, at = words(data, starts)
                    for k in range(len(starts) - 1):
                        for item, low, passage in index.passages(h[at[k] : at[k + 1]]):
                            a = index.words(item)
                            if not enough(MATCH * int(np.isin(a, passage).sum()), a):  # each word of the item matches once at most
                                continue
                            best, begin, end = align(a, passage)
                            if enough(best, a):
                                out.append((ids[first + k].as_py(), keys[first + k].as_py(), index.ids[item], best, best / (MATCH * len(a)), low + begin, low + end))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        scored = scratch.append(docs.mapInArrow(find, FOUND), "scored")
        shared.destroy()
    return scored


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document (doc_id, text) and a test item (item_id, text) that it holds.

    Columns: doc_id, item_id, score (best alignment), share (of the best possible score), span_start and
    span_end (words of the document, lower-cased, between white space). Null or empty texts are
    never in the result. Items of fewer than MIN_WORDS words are found by exact copies of all their words. An item
    without an id is known by the ids of items with the same text, else by the null id, which all such items
    share; documents without an id share the null id too. Of repeated ids the best pair is given. Empty
    tables give an empty result. Other columns are ignored.
    """
    scored = _scored(docs, benchmark, Scratch(docs.sparkSession, "decontamination"))
    best = F.max(F.struct("score", "share", (-F.col("span_start")).alias("s"), "span_end")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.share", (-F.col("b.s")).alias("span_start"), "b.span_end")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no test item, with their columns unchanged.

    Rows are judged one by one: a row without an id goes if it holds an item, and of rows that share an id only those that do.
    Rows given twice go or stay together. Null and empty texts stay. Empty tables are taken as they are.
    """
    key = fresh(docs, "__key")
    leaks = _scored(docs, benchmark, Scratch(docs.sparkSession, "decontamination")).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(leaks, key, "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
