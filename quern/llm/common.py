"""Shared helpers: scratch tables in the cluster's shared folder, and access to Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import shared

#: Rows of one Arrow batch sent to a Python worker. Texts can be long, so batches are kept short.
BATCH_ROWS = 512
#: Bytes of text handled at once by the vectorised functions.
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, and let Spark delete a query's shuffle files when its action ends."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch(shared.Scratch):
    """Scratch tables of an operator, with the session prepared for it."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        super().__init__(spark, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % folds


def row_key() -> Column:
    """The key of a row of documents, from its id and its text. Rows that agree on both are one document."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores until `df` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def sample_of(labels: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of `labels`, the same ones each time, chosen by a hash of doc_id. All rows if there are fewer."""
    n = labels.count()
    if n <= rows:
        return labels
    return labels.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))


def how_common(sketch: np.ndarray) -> np.ndarray:
    """How common the tokens of each counter are: 0 up to 8 times the median counter, then one more for each doubling."""
    usual = np.median(sketch) + 4 * np.sqrt(np.median(sketch)) + 8
    return np.clip(np.ceil(np.log2(np.maximum(sketch, 1) / usual)) + 1, 0, 63).astype(np.uint8)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes: first row, last row + 1, their bytes in one array, row starts (one more than rows)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


# Polynomial fingerprints over bytes, modulo 2**64: the span [a, b) has (S[b] - S[a]) / BASE**a, so that
# equal spans have equal fingerprints wherever they stand.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * power("up", len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sums[b] - sums[a]) * power("down", len(sums))[a]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a uint64 array (the well-known finaliser of murmur3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, with A-Z lower-cased: fingerprint of each, row of each, first word of each row (one more than rows)."""
    n, rows = len(data), len(starts) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = mix(spans(prefix_sums(data), a, b) + (b - a).astype(np.uint64))
    first = np.searchsorted(a, starts)
    return h, np.repeat(np.arange(rows), np.diff(first)), first


def shingles(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row: fingerprints, and the row of each, in order of row and fingerprint.

    A row with fewer words than `width` has its whole sequence as one shingle; one without words has none.
    """
    h, row, first = words(data, starts)
    counts = np.diff(first)
    mult = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(width)], np.uint64)
    if len(h) >= width:
        n = len(h) - width + 1
        s = np.zeros(n, np.uint64)
        for j in range(width):
            s += h[j : j + n] * mult[j]
        whole = row[:n] == row[width - 1 :]
        s, r = mix(s[whole]), row[:n][whole]
    else:
        s, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int((h[first[k] : first[k + 1]] * mult[: counts[k]]).sum(dtype=np.uint64)) for k in short], np.uint64)
        s = np.concatenate([s, mix(extra + counts[short].astype(np.uint64))])
        r = np.concatenate([r, short])
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        s, r = s[new], r[new]
    return s, r


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
