"""Periodic runs of words, found online by catchers over dyadic blocks.

A run is a stretch of words that repeats with smallest period q over at least `MIN_POWER` periods and
`MIN_WORDS` words, and that no neighbouring word extends. Words are appended to a `SquareCatcher` in pieces of any size.

For each power of two L, every completed block of L words at a multiple of L has a catcher. It watches for the
block to come back at a distance q in [2L, 4L) (from 1 on for L = 1). The first block that begins inside a run of period q, the catcher's, does
come back, together with all that follows it up to the least length of a run. When the last of these words is appended, the fingerprints
of both suffixes are compared: once for each (block, distance), so twice for each word and level. A match is compared word by
word, extended to the left, and followed as further words are appended until one breaks it. Squares that lie in a
stretch that is being followed merge into it, and so do multiples of its period.

Equal words have equal numbers and equal suffixes have equal fingerprints, so nothing is missed; what
fingerprints find is compared, so nothing is found wrongly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import BASE, as_bytes, mix, power, prepare, read

MIN_WORDS, MIN_POWER = 24, 3
#: Words appended at a time.
PIECE = 1 << 15


def least_length(q: np.ndarray | int) -> np.ndarray | int:
    """The least length of a run of period q."""
    return np.maximum(MIN_WORDS, MIN_POWER * q)


class SquareCatcher:
    """Finds the runs of a sequence of word numbers that is appended piece by piece."""

    def __init__(self) -> None:
        self.n = 0
        self._words = np.zeros(1024, np.int64)
        self._sums = np.zeros(1025, np.uint64)
        self._open: list[list[int]] = []  # start, end so far, period; all that goes on to the last word
        self._closed: list[list[int]] = []

    def append(self, words: np.ndarray) -> None:
        """Advance all catchers by `words` (numbers, equal for equal words)."""
        begin, self.n = self.n, self.n + len(words)
        if self.n > len(self._words):
            grown = max(2 * len(self._words), self.n)
            self._words = np.concatenate([self._words[:begin], np.zeros(grown - begin, np.int64)])
            self._sums = np.concatenate([self._sums[: begin + 1], np.zeros(grown - begin, np.uint64)])
        self._words[begin : self.n] = words
        codes = mix(np.asarray(words, np.int64).astype(np.uint64) + np.uint64(1)) * power("up", len(words)) * np.uint64(pow(BASE, begin, 1 << 64))
        self._sums[begin + 1 : self.n + 1] = self._sums[begin] + np.cumsum(codes, dtype=np.uint64)
        self._follow(self._open)
        length = 1
        while 5 * length < self.n:  # the shortest test of a level ends beyond that
            self._catch(length, begin)
            length *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of all words so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, q in (*self._closed, *self._open):
            if end - start >= least_length(q):
                least[start, end] = min(q, least.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in least.items())

    def _follow(self, trails: list[list[int]]) -> None:
        """Move the ends of trails as far as words repeat; those that break are closed, the rest stays open."""
        still = []
        for trail in trails:
            trail[1] += self._equal(trail[1], trail[1] - trail[2], self.n - trail[1])
            (still if trail[1] == self.n else self._closed).append(trail)
        self._open = still

    def _equal(self, a: int, b: int, most: int) -> int:
        """Words from a on that equal those from b on, at most `most`."""
        done, step = 0, 64
        while done < most:
            step = min(step, most - done)
            differ = np.flatnonzero(self._words[a + done : a + done + step] != self._words[b + done : b + done + step])
            if len(differ):
                return done + int(differ[0])
            done, step = done + step, 4 * step
        return most

    def _equal_back(self, a: int, b: int, most: int) -> int:
        """Words before a that equal those before b, at most `most`."""
        done, step = 0, 64
        while done < most:
            step = min(step, most - done)
            differ = np.flatnonzero(self._words[a - done - step : a - done] != self._words[b - done - step : b - done])
            if len(differ):
                return done + step - 1 - int(differ[-1])
            done, step = done + step, 4 * step
        return most

    def _catch(self, length: int, begin: int) -> None:
        """Compare the suffixes that end in the words from `begin` on with the blocks of `length` words, and open trails."""
        low, high = (2 * length, 4 * length - 1) if length > 1 else (1, 3)
        q = np.arange(low, high + 1)
        span = least_length(q) - q - length + 1  # of what is compared, from the block on
        first = np.maximum(0, -((span + q - begin - 1) // length))  # the first block whose test ends after `begin`
        last = (self.n - q - span) // length
        count = np.maximum(0, last - first + 1)
        if not count.any():
            return
        which = np.repeat(np.arange(len(q)), count)
        at = (first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * length
        q, span = q[which], span[which]
        sums = self._sums
        same = (sums[at + span] - sums[at]) * power("up", high + 1)[q] == sums[at + q + span] - sums[at + q]
        at, q, end = at[same], q[same], (at + q + span)[same]
        if not len(at):
            return
        order = np.lexsort((q, at))
        at, q, end = at[order], q[order], end[order]
        left = np.ones(len(at), bool)

        def merge(start: int, stop: int, period: int) -> None:
            """Matches within a stretch, as a multiple of its period, are known."""
            inside = slice(*np.searchsorted(at, (start, stop)))
            left[inside] &= (end[inside] > stop) | (q[inside] % period != 0)

        for trail in (*self._open, *self._closed[-256:]):
            merge(*trail)
        k = 0
        while (k := k + int(np.argmax(left[k:]))) < len(at) and left[k]:
            a, period, stop = int(at[k]), int(q[k]), int(end[k])
            left[k] = False
            if self._equal(a, a + period, stop - a - period) == stop - a - period:
                trail = [a - self._equal_back(a, a + period, a), stop, period]
                still = self._open
                self._follow([trail])
                self._open = still + self._open
                merge(*trail)


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of words, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs_of(words: list[bytes], piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    numbers, catcher = numbered(words), SquareCatcher()
    for k in range(0, len(numbers), piece):
        catcher.append(numbers[k : k + piece])
    return catcher.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    if runs:
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run in each text of (doc_id, text); words are split at ASCII white space.

    Null, empty and short texts have no runs. Texts may be of any length. Repeated rows give their runs each. An
    empty table gives an empty result. Other columns are ignored. One pass without a shuffle.
    """
    prepare(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(t.split()) for t in as_bytes(batch.column(1))]
            row = pa.array([k for k, runs in enumerate(found) for _ in runs], pa.int64())
            flat = [run for runs in found for run in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *(pa.array([run[k] for run in flat], pa.int64()) for k in range(3))], ["doc_id", "start", "length", "period"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(find, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Texts of (doc_id, text) in which each run is cut to its first period: doc_id, n_words, n_kept, text (kept words joined by blanks).

    A null text stays null with no words. Other cases are those of `periodic_runs`.
    """
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split() for t in as_bytes(batch.column(1))]
            kept = [collapsed(w, runs_of(w)) for w in words]
            texts = pa.array([k if there else None for k, there in zip(kept, batch.column(1).is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
            counts = pa.array([k.count(b" ") + 1 if k else 0 for k in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), counts, texts], ["doc_id", "n_words", "n_kept", "text"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(cut, "doc_id long, n_words long, n_kept long, text string")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as op12 takes them: a tenth of the documents, by crc32 of the id, repeat a piece of themselves. A null id counts as the empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, greatest run and digests for each document."""
    prepare(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = repeated_tail(doc_id, text.split())
                runs = runs_of(words)
                best = None
                for run in runs:  # by start, then period: the first of equals stays
                    if best is None or run[1] * best[2] > best[1] * run[2]:
                        best = run
                lines = b"".join(b"%d,%d,%d\n" % run for run in runs)
                out.append((doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RUNS.split(", ")])

    docs = read(spark, sf_dir, "documents")
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(digest, RUNS)
