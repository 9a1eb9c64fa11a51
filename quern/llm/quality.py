"""Quality: Bradley-Terry ranking of documents, learned from preference pairs.

Each pair is a preferred and a rejected labelled document. The logistic loss on the difference of
their features gives weights, so that w . x is a document's strength; the model never sees a single
document's label, only who wins. The strength is then cut at the quantile of labelled documents that
matches the share of rejected ones, and mapped to (0, 1) with 0.5 at the cut.

Features are shape statistics of the text (lengths, shares of kinds of bytes, repetition), all relative,
so they work for any language. Learning takes all labelled rows and all their pairs, by Newton's method: a step
is one pass over the features, in which tasks sum gradient and curvature, and one that counts strengths by steps of 1 / STEPS,
from which the loss of all pairs follows without listing them. Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, as_bytes, fold, prepare, read
from quern.llm.linear import sigmoid
from quern.llm.toxicity import labelled_rows

#: Strengths are counted by steps of 1 / STEPS. The curvature of the loss, which decides how soon the weights are found and not which, takes steps of 1 / 4, KNOTS of them.
STEPS, KNOTS = 64, 256
#: Newton steps at most; the last one is that which promises a gain of less than GAIN.
MAX_STEPS, GAIN = 40, 1e-8
_CLASSES = np.zeros(256, np.int64)  # 0: other control bytes
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"*#$%&@~^_+=", b"|<>[]{}\\/`", bytes(range(128, 256))), 1):
    _CLASSES[list(_bytes)] = _k
N_CLASSES = int(_CLASSES.max()) + 1


def features(text: bytes) -> np.ndarray:
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    share = np.bincount(_CLASSES[data], minlength=N_CLASSES) / max(n, 1)
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(words)
    ends = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / max(len(lines), 1)
    mean = lengths.mean()
    tail = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:!?") for w in words) / max(len(words), 1)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(len(words) - 2, 1)
    bits = np.bincount(data, minlength=256) / max(n, 1)
    entropy = -(bits[bits > 0] * np.log2(bits[bits > 0])).sum()
    return np.array([
        *share, *np.sqrt(share), np.log1p(n), np.log1p(n) ** 2 / 10, np.log1p(len(words)), mean, np.log1p(mean), lengths.std(), np.log1p(lengths.max()),
        len(distinct) / max(len(words), 1), np.log1p(len(distinct)), min(triples, 1.0), len(set(lines)) / max(len(lines), 1), ends, tail,
        np.log1p(n / max(len(lines), 1)), np.log1p(len(lines)), sum(w[:1].isupper() for w in words) / max(len(words), 1), sum(w.isupper() for w in words) / max(len(words), 1), entropy, float(n == 0),
    ])


@dataclass
class Ranking:
    """Strength of x: weights . ((x - mean) / spread). Score: sigmoid((strength - cut) / width)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return sigmoid((_cross(z) @ self.weights - self.cut) / self.width)


def _cross(z: np.ndarray) -> np.ndarray:
    """Features, their squares and bumps at 0, so that too much and too little can both lose."""
    return np.concatenate([z, z * z / 4, np.exp(-z * z)], axis=1)


def _labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y): features, as bytes, of each labelled row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "y"])

    # labels grow with the documents, so they are never broadcast
    return labelled_rows(docs, labels.hint("merge"), "quality").mapInArrow(run, "x binary, y int")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(batch.num_rows, -1), batch.column(1).to_numpy()


def _summed(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The sum of `part` of the rows of each task that has any; there are no more tasks than cores, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(*_arrays(batch))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return [np.frombuffer(r.total, np.float64) for r in table.mapInArrow(run, "total binary").collect()]


def _moments(table: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean and spread of the features, rows of label 0 and 1. The squares are taken around the mean."""
    sums = sum(_summed(table, lambda x, y: np.array([len(y), y.sum(), *x.sum(0)])), np.zeros(2 + len(features(b""))))
    n, good = int(sums[0]), int(sums[1])
    if not n:
        return features(b""), np.full(len(sums) - 2, 1e-6), 0, 0
    mean = sums[2:] / n
    squares = sum(_summed(table, lambda x, _: ((x - mean) ** 2).sum(0)), np.zeros(len(mean)))
    return mean, np.sqrt(squares / n) + 1e-6, n - good, good


def _strengths(table: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(s, y): strength of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _cross(np.clip((_arrays(batch)[0] - mean) / spread, -8, 8)) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], ["s", "y"])

    return table.mapInArrow(run, "s double, y int")


@dataclass
class _Counted:
    """Strengths of one label, by steps: number of each step, mean strength and share of its rows."""

    step: np.ndarray
    s: np.ndarray
    share: np.ndarray


def _counted(strengths: DataFrame) -> tuple[_Counted, _Counted]:
    """The steps of labels 0 and 1, in order."""
    rows = strengths.groupBy("y", F.floor(F.col("s") * STEPS).alias("step")).agg(F.count("*").alias("n"), F.sum("s").alias("s")).toPandas().sort_values(["y", "step"])
    out = []
    for label in (0, 1):
        r = rows[rows["y"] == label]
        n = r["n"].to_numpy(np.float64)
        out.append(_Counted(r["step"].to_numpy(np.int64), r["s"].to_numpy(np.float64) / n, n / n.sum()))
    return out[0], out[1]


def _against(f: Callable[[np.ndarray], np.ndarray], s: np.ndarray, others: _Counted) -> np.ndarray:
    """The mean of f(strength of another - s) over the other label's rows, for each s; some at a time."""
    return np.concatenate([f(others.s - s[k : k + 256, None]) @ others.share for k in range(0, len(s), 256)])


def _slope(d: np.ndarray) -> np.ndarray:
    p = sigmoid(d)
    return p * (1 - p)


def _loss(bad: _Counted, good: _Counted) -> float:
    """The mean loss of all pairs."""
    return float(good.share @ _against(lambda d: np.logaddexp(0, d), good.s, bad))


def _newton(table: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, bad: _Counted, good: _Counted, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the loss of all pairs and the step that Newton's method takes off."""
    n = len(weights)
    edges = {y: np.union1d(c.step, c.step + 1) / STEPS for y, c in ((0, bad), (1, good))}
    pull = {0: _against(lambda d: sigmoid(-d), edges[0], good), 1: -_against(sigmoid, edges[1], bad)}  # of a row on the gradient, at the ends of its step
    low = (float(bad.share @ bad.s) + float(good.share @ good.s)) / 2 - KNOTS / 8
    place = lambda s: np.clip(np.floor((s - low) * 4).astype(np.int64), 0, KNOTS - 1)
    slope = _slope((np.arange(KNOTS)[:, None] - np.arange(KNOTS)) / 4)
    at = {y: np.bincount(place(c.s), c.share, KNOTS) for y, c in ((0, bad), (1, good))}
    bend = {0: slope @ at[1], 1: slope @ at[0]}

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _cross(np.clip((x - mean) / spread, -8, 8))
        s = z @ weights
        k = place(s)
        out = []
        for label in (0, 1):
            mine, own, ks = z[y == label], s[y == label], k[y == label]
            inside = np.zeros((KNOTS, n))
            np.add.at(inside, ks, mine)
            rows = np.bincount(ks, minlength=KNOTS).astype(np.float64)
            out += [[len(mine)], np.interp(own, edges[label], pull[label]) @ mine, ((mine * bend[label][ks, None]).T @ mine).ravel(), inside.ravel(), rows]
        return np.concatenate(out)

    total = sum(_summed(table, part))
    gradient, curve, inside, weight = 2 * l2 * weights, 2 * l2 * np.eye(n), {}, {}
    for label, t in zip((0, 1), np.split(total, 2), strict=True):
        rows, pulled, squares, sums, counts = np.split(t, np.cumsum([1, n, n * n, KNOTS * n]))
        gradient = gradient + pulled / rows
        curve = curve + squares.reshape(n, n) / rows
        inside[label], weight[label] = sums.reshape(KNOTS, n) / rows, counts / rows
    across = inside[1].T @ slope @ inside[0]
    return gradient, np.linalg.solve(curve - across - across.T, gradient)


def _quantile(strengths: DataFrame, n: int, share: float) -> float:
    """The quantile of `n` strengths as numpy has it, from the two strengths around its place; each is found in ever smaller steps, by counting."""
    place = share * (n - 1)
    ends = strengths.agg(F.min("s").alias("low"), F.max("s").alias("high")).first()

    def ranked(rank: int) -> float:
        low, high, below = ends.low, ends.high, 0
        while high - low > 1e-12 * max(1.0, abs(low), abs(high)):
            width = (high - low) / 1024
            inside = strengths.filter((F.col("s") >= F.lit(low)) & (F.col("s") <= F.lit(high)))
            steps = inside.groupBy(F.floor((F.col("s") - F.lit(low)) / F.lit(width)).alias("step")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            for r in sorted(steps.collect(), key=lambda r: r.step):
                if rank < below + r.n:
                    break
                below += r.n
            if rank == below:
                return r.low
            if rank == below + r.n - 1:
                return r.high
            low, high = r.low, r.high
        return low

    first, last = int(np.floor(place)), int(np.ceil(place))
    low = ranked(first)
    return low if first == last else low + (place - first) * (ranked(last) - low)


def learn(table: DataFrame, l2: float = 1e-4) -> Ranking:
    """Fit the ranking to all rows (x, y) of a table of features that may be read many times, and to all pairs of a preferred (1) and a rejected (0) one. With one class only, all scores are 0.5.

    The driver gets a few sums and counts of strengths of each pass, never rows.
    """
    table = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)
    mean, spread, n_bad, n_good = _moments(table)
    w = np.zeros(3 * len(mean))
    if not n_bad or not n_good:
        return Ranking(mean, spread, w, 0.0, 1.0)
    bad, good = _counted(_strengths(table, mean, spread, w))
    loss = _loss(bad, good)
    for _ in range(MAX_STEPS):
        gradient, step = _newton(table, mean, spread, w, bad, good, l2)
        gain, t = float(gradient @ step), 1.0
        while gain > GAIN and t > 1e-3:
            new = w - t * step
            counted = _counted(_strengths(table, mean, spread, new))
            after = _loss(*counted) + l2 * float(new @ new)
            if after <= loss - 1e-4 * t * gain:
                break
            t /= 2
        else:
            break
        w, (bad, good), loss = new, counted, after
    strengths = _strengths(table, mean, spread, w)
    cut = _quantile(strengths, n_bad + n_good, n_bad / (n_bad + n_good))
    deviation = strengths.agg(F.stddev_pop("s")).first()[0]
    return Ranking(mean, spread, w, float(cut), max(float(deviation) / 4, 1e-6))


def score_texts(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score) of every text of (doc_id, text)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def _scores(model: Ranking, texts: pa.Array) -> np.ndarray:
    return model.scores(np.stack([features(t) for t in as_bytes(texts)])) if len(texts) else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int | None = 1, threshold: float = 0.5) -> DataFrame:
    """Score each document's quality; labels are learned only from rows outside the held-out fold.

    Null and empty texts are scored as the empty text. Repeated rows are scored alike. An empty table gives an
    empty result; without labels of both classes every score is 0.5. Other columns are ignored.
    """
    scored = score_texts(docs, fit(docs, labels, folds, held_out))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int | None = 1) -> Ranking:
    """The ranking learned from all labelled documents outside the held-out fold. Their features are written to the shared folder while it is fitted."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.save(_labelled_features(docs, labels.filter(fold("doc_id", folds) != held_out)), "features")
    model = learn(table)
    scratch.drop("features")
    return model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score `threshold` or more, with their columns unchanged.

    Null and empty texts are judged as the empty text, rows without an id by their text, repeated rows alike. An empty table
    gives an empty result; without labels of both classes all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")  # only the text goes to Python
    def score(text: pa.Array) -> pa.Array:
        return pa.array(_scores(shared.value, text))

    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
