"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): with p and q the smoothed counts of texts of either class that hold a
feature, r = log((p / |p|) / (q / |q|)); a logistic model is learned over features with the value r.
Features are the n-grams of 3 to 5 bytes of the UTF-8 text, A-Z lower-cased, white space as one blank,
hashed to 2 ** BITS numbers; what counts is whether a text holds them, so one insult in a long text shows.

Learning takes a bounded sample of labelled rows (`max_rows`), whose counts and features are made in tasks; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, as_bytes, fold, prepare, read, sample_of
from quern.llm.linear import fit_sparse, sigmoid

BITS = 20
#: Labelled rows that the model is learned from, at most (about: chosen by hash).
MAX_ROWS = 12_000
#: Texts that must hold a feature for it to count, and the least |r| of a feature in use.
MIN_TEXTS, MIN_RATIO = 3, 0.7
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32


def gram_ids(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text. `seen` is a scratch array of 2 ** BITS int32, reused between calls."""
    b = _FOLDED[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint64)
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
    four = three[:-1] | b[3:] << np.uint64(24)
    five = four[:-1] | b[4:] << np.uint64(32)
    mult = np.uint64(0x9E3779B97F4A7C15)
    h = np.concatenate([(g + np.uint64((n << 40) + 1)) * mult >> np.uint64(64 - BITS) for n, g in ((3, three), (4, four), (5, five))]).astype(np.int64)
    order = np.arange(len(h), dtype=np.int32)
    seen[h] = order
    return h[seen[h] == order]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold each n-gram, of (text, y)."""
    seen, counts = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label, gram_ids(text, seen)] += 1
    held = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[0, held].astype(np.int64)), pa.array(counts[1, held].astype(np.int64))], ["gram", "n0", "n1"])


def learn(sample: DataFrame, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weight of each hashed n-gram (float32) and bias, from a bounded table (text, y). With one class only, the weights are 0 and the bias its log odds.

    The texts stay in the tasks: the driver gets a count for each n-gram (2 ** BITS at most), then for each text
    the numbers of the n-grams in use that it holds.
    """
    spark = sample.sparkSession
    weights = np.zeros(1 << BITS, np.float32)
    of_label = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(of_label) < 2:
        return weights, float(np.log((of_label.get(1, 0) + 0.5) / (of_label.get(0, 0) + 0.5)))
    rows = sample.mapInArrow(_count_grams, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[:, rows["gram"].to_numpy()] = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    p, q = counts[1] + 1, counts[0] + 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    used = np.flatnonzero((counts.sum(0) >= MIN_TEXTS) & (np.abs(r) >= MIN_RATIO))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = spark.sparkContext.broadcast(place)  # 2 ** BITS numbers

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            held = [shared.value[gram_ids(t, seen)] for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in held], pa.binary()), batch.column(1)], ["held", "y"])

    table = sample.mapInArrow(numbers, "held binary, y int").toArrow()
    shared.destroy()
    held = [np.frombuffer(x, np.int32) for x in table["held"].to_pylist()]
    w, bias = fit_sparse(held, np.array(table["y"].to_pylist(), np.int64), len(used), r[used], l2)
    weights[used] = w
    return weights, bias


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every text of (doc_id, text); a null text is scored as the empty one."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast((weights, bias))  # 2 ** BITS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            z = np.array([b + w[gram_ids(t, seen)].sum(dtype=np.float64) for t in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sigmoid(z))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, y) of all labelled documents, y 0 or 1. Null labels and ids don't count; of repeated ids, all rows do."""
    labels = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(labels, "doc_id").select("text", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, scratch: Scratch) -> DataFrame:
    """Table of `labelled_rows` for labels of at most about `max_rows` documents."""
    chosen = sample_of(labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()), max_rows)  # bounded by max_rows, so it may be broadcast
    return scratch.save(labelled_rows(docs, F.broadcast(chosen), label), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Score each document's toxicity; labels are learned only from rows outside the held-out fold.

    Null and empty texts get the score of a text without features. Repeated rows are scored alike. An empty
    table gives an empty result; without labels every score is 0.5. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = learn(labelled_sample(docs, labels.filter(fold("doc_id", folds) != held_out), "toxic", max_rows, scratch))
    scratch.drop("labelled")
    scored = score_texts(docs, *model)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
