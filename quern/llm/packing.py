"""Packing token sequences along a space-filling curve.

Each text becomes a hashed vector of its words, projected to three dimensions; the Hilbert index of
the projection is its key. Documents are range-sorted by (key, doc_id), so that alike documents lie
together, and the stream of their tokens is cut every `length` ids. Only the last sequence has padding.

A document's place in the stream is the total of the range partitions before its own plus its place
in that partition. Only one number for each partition is looked at together.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, chunks, read, words

DIMS, BITS, WIDTH = 3, 10, 1 << 12
_PLANES = np.random.default_rng(11).standard_normal((WIDTH, DIMS))


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of x, each coordinate below 2 ** bits), by Skilling's transposition (2004)."""
    x = x.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            on = (x[i] >> level) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            out = out << 1 | ((x[i] ^ flip) >> level) & 1
    return out


def curve_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hilbert keys of the texts of one chunk. A text without words has the vector 0."""
    h, row, _ = words(data, starts)
    rows = len(starts) - 1
    cells, counts = np.unique(row * WIDTH + (h >> np.uint64(52)).astype(np.int64), return_counts=True)
    at, weight = cells // WIDTH, np.log1p(counts)
    norm = np.sqrt(np.maximum(np.bincount(at, weight * weight, rows), 1e-12))
    point = np.stack([np.bincount(at, weight * _PLANES[cells % WIDTH, k], rows) / norm for k in range(DIMS)], axis=1)
    unit = 1 / (1 + np.exp(-1.702 * point))  # about the normal distribution, so the grid is filled evenly
    return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Encoder:
    """Ids of byte_bpe_50k as the plain `tokenizers` call gives them, as little-endian 16-bit numbers.

    This vocabulary's pre-tokens never span the place before a single blank or line feed between two characters that aren't white space, so a
    text is cut there. The parts of a chunk of texts are numbered by Arrow, and new ones encoded once and kept: those without other white space
    together, as one text in which each begins with the token that has its blank or line feed. A text that holds one of the vocabulary's special tokens,
    or white space beyond ASCII, is encoded whole.
    """

    #: Parts kept, and their bytes; beyond that only those stay that a second chunk had.
    LIMIT, BYTES = 800_000, 32 << 20
    _white = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
    #: The first two bytes of white space beyond ASCII in UTF-8 (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000); number of each first byte.
    _pairs = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
    _lead = np.zeros(256, np.int64)
    _lead[[0xC2, 0xE1, 0xE2, 0xE3]] = [1, 2, 3, 4]
    _blank = np.zeros(5 * 256, bool)
    for _a, _b in _pairs:
        _blank[_lead[_a] * 256 + _b] = True

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        vocabulary = self.full.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(("Ġ", "Ċ"))]] = True
        self._forget()

    def _forget(self) -> None:
        """Begin with no parts: number of each, and by number its ids' place and count, and the chunks that had it."""
        self.known: dict[bytes, int] = {}
        self.first, self.count, self.ids, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2"), 0
        self.chunks = np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep what more than one chunk had, if that is not most."""
        stay = self.chunks > 1
        if 2 * stay.sum() > self.LIMIT:
            return self._forget()
        kept = [x for x, k in self.known.items() if stay[k]]  # in order of their numbers
        self.ids = self.ids[np.repeat(stay, self.count)]
        self.count = self.count[stay]
        self.first, self.chunks = np.cumsum(self.count) - self.count, np.ones(len(kept), np.int64)
        self.known, self.held = {x: k for k, x in enumerate(kept)}, sum(map(len, kept))

    def parts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where parts begin in the bytes of texts; all but a text's first begin with a blank or line feed."""
        white = self._white[data]
        cut = (data == 32) | (data == 10)
        cut[:1] = cut[-1:] = False
        cut[1:-1] &= ~white[:-2] & ~white[2:]
        inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
        cut[inner] = cut[inner - 1] = False  # at a text's ends
        for k in np.unique(np.searchsorted(starts, self._odd(data), side="right") - 1):
            cut[starts[k] : starts[k + 1]] = False
        cut[starts[:-1][starts[:-1] < starts[1:]]] = True
        return np.flatnonzero(cut)

    def _odd(self, data: np.ndarray) -> np.ndarray:
        """Places of special tokens, and of characters of which some are white space beyond ASCII."""
        raw, found = data.tobytes(), []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        code = self._lead[data[:-1]] * 256 + data[1:]
        return np.concatenate([np.array(found, np.int64), np.flatnonzero(self._blank[code])])

    def _learn(self, parts: list[bytes]) -> None:
        """Number new parts and keep their ids."""
        ids, counts, order, rest = [], [], [], []
        plain = [x[:1] in (b" ", b"\n") and x[1:].split() == [x[1:]] for x in parts]
        simple = [x for x, p in zip(parts, plain, strict=True) if p]
        bunches = [simple[k : k + 256] for k in range(0, len(simple), 256)]
        for some, whole in zip(bunches, self.full.encode_batch_fast([b"".join(x).decode() for x in bunches], add_special_tokens=False), strict=True):
            found = np.array(whole.ids, "<u2")
            at = np.flatnonzero(self.begins[found])
            if len(at) == len(some):
                ids.append(found)
                counts.append(np.diff(np.append(at, len(found))))
                order += some
            else:  # of another vocabulary
                rest += some
        rest += [x for x, p in zip(parts, plain, strict=True) if not p]
        each = [np.array(e.ids, "<u2") for e in self.full.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)]
        count = np.concatenate([self.count, *counts, np.fromiter(map(len, each), np.int64, len(each))])
        self.known.update(zip(order + rest, range(len(self.known), len(count)), strict=True))
        self.ids, self.count, self.first = np.concatenate([self.ids, *ids, *each]), count, np.cumsum(count) - count
        self.held += sum(map(len, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [ids for _, _, data, starts in chunks(pa.array(texts, pa.large_string()), TOGETHER) for ids in self.encode_chunk(data, starts)]

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))

    def encode_chunk(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of each text of a chunk."""
        begin = self.parts(data, starts)
        offsets = np.append(begin, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        unique = parts.dictionary.to_pylist()
        numbers = self._numbers(unique)
        if len(self.known) + (numbers < 0).sum() > self.LIMIT or self.held > self.BYTES:
            self._thin()
            numbers = self._numbers(unique)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [unique[k] for k in missing.tolist()]
            self._learn(new)
            numbers[missing] = self._numbers(new)
        self.chunks = np.append(self.chunks, np.zeros(len(self.count) - len(self.chunks), np.int64))
        self.chunks[numbers] += 1
        number = numbers[parts.indices.to_numpy()]
        count = self.count[number]
        end = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[number] - end[:-1], count) + np.arange(end[-1])].tobytes()
        bounds = (2 * end[np.searchsorted(begin, starts)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Characters of text that are encoded together, and bytes of ids that a range should hold.
TOGETHER, RANGE_BYTES = 4 << 20, 16 << 20


def _encode(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Key, row number and ids of each text of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1), TOGETHER):
                ids = [x + b"\0\0" for x in encoder(path).encode_chunk(data, starts)]
                rows = np.arange(row, row + last - first)
                row += last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(curve_keys(data, starts)), pa.array(rows), pa.array(ids, pa.binary())], ["doc_id", "key", "row", "ids"])

    return run


def _in_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each document's first id in its range of the curve."""
    context, at = TaskContext.get(), 0
    part = context.partitionId() if context else 0
    for batch in batches:
        n = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // 2
        starts = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(starts), pa.array(n), batch.column(1)], ["part", "doc_id", "begin", "doc_tokens", "ids"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = 1024, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of `length` ids; one row for each piece of a document in a sequence.

    Each document is its ids and a final 0. A null or empty text has only that. Repeated rows are each packed.
    An empty table gives an empty result. `with_ids` adds each piece's ids. `vocabulary` is the path of a tokenizer file of the
    `tokenizers` library; None: byte_bpe_50k. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = scratch.save(docs.mapInArrow(_encode(vocabulary), "doc_id long, key long, row long, ids binary"), "encoded")
    n_bytes = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    ordered = encoded.repartitionByRange(ranges, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").select("doc_id", "ids")
    tokens = scratch.save(ordered.mapInArrow(_in_line, "part int, doc_id long, begin long, doc_tokens long, ids binary"), "tokens")
    scratch.drop("encoded")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = scratch.save(offsets, "offsets")  # a row for each partition, so it may be broadcast
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("begin"), "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out, held = [], []
            for doc, begin, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(begin + at, length)
                    piece = ids[at : at + length - offset]
                    out.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset))
                    if with_ids:
                        held.append(piece.astype(np.int32))
                    at += len(piece)
            columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.list_(pa.int32()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return placed.mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
