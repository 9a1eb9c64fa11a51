"""Exact removal of repeated long byte strings, by a logarithmic family of sparse suffix arrays.

A byte goes if a string of LENGTH bytes over it also starts anywhere else.

Sampling. Among the GRAM-byte strings that begin in a window of LENGTH bytes, the one with the least hash
(the leftmost of equals) is the window's anchor. Equal windows have their anchors at the same place, so it
is enough to index the suffixes that begin at anchors, about 1 in 80 of all. Successive windows with one
anchor form a run; an index entry is a run: the first GRAM bytes of its anchor's suffix, by which the array is sorted, and a
fingerprint of all the bytes its windows cover, by which suffixes that agree so far are told apart.

Index family. Documents come in batches. A batch's entries are sorted into a suffix array (range-partitioned, so one order over
all its files), equal ones counted; the array is merge-scanned with itself and with every level of the index for suffixes that
agree in GRAM bytes, and becomes a level. Two levels of one rank merge to one of the next, so each entry is rewritten
logarithmically often, but for the last batch, after which nothing is added.

Matches. From what agrees, matches are extended to both sides. Runs of equal bytes match whole. Where runs share the anchor but not all bytes, their windows are
compared one by one: in sorted streams while an anchor has few distinct runs, and by an aggregation over
all window fingerprints beyond that. Copies are counted before they are shuffled, and stand for one run. Anchors are compared as bytes; of runs and windows
of one anchor, 64-bit fingerprints are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, as_bytes, chunks, mix, prefix_sums, read, row_key, signed, spans

LENGTH, GRAM = 200, 40
#: Bytes of text in which runs are found at a time: arrays of eight bytes for each stay in a processor's cache.
CHUNK = 1 << 18
#: Distinct runs of one anchor up to which a task compares them in one stream, and rows of a stream that it compares at a time.
STREAM_RUNS, STREAM_ROWS = 512, 4096


def runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows of the texts in one chunk: row, first window, number of windows, anchor (from the first window), where it is in the chunk, fingerprint of the run."""
    n, reach = len(data), length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "first", "n", "anchor", "at", "run")}
    if n < length:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    marks = mix(spans(sums, at, at + gram))
    low = (marks >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= reach:  # least of `width` successive places, doubled
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= starts[1:][row]
    w = np.flatnonzero(inside)
    if not len(w):
        return none
    new = np.ones(len(w), bool)
    new[1:] = (anchor[w[1:]] != anchor[w[:-1]]) | (row[w[1:]] != row[w[:-1]])
    first = w[new]
    count = np.diff(np.append(np.flatnonzero(new), len(w)))
    a = anchor[first]
    whole = spans(sums, first, first + count - 1 + length)
    shape = (a - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
    return {"row": row[first], "first": first - starts[row[first]], "n": count, "anchor": a - first, "at": a, "run": signed(mix(whole ^ mix(shape)))}


ENTRIES = "doc_id long, key long, first int, n int, anchor int, suffix binary, run long"


def entries(docs: DataFrame) -> DataFrame:
    """Index entries of (doc_id, key, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, starts in chunks(batch.column(2), CHUNK):
                r = runs(data, starts)
                row = pa.array(r["row"] + first)
                grams = data[r["at"][:, None] + np.arange(GRAM)] if len(r["at"]) else np.zeros(0, np.uint8)
                suffix = pa.Array.from_buffers(pa.binary(), len(r["at"]), [None, pa.py_buffer(np.arange(len(r["at"]) + 1, dtype=np.int32) * GRAM), pa.py_buffer(np.ascontiguousarray(grams))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(r["first"].astype(np.int32)), pa.array(r["n"].astype(np.int32)), pa.array(r["anchor"].astype(np.int32)), suffix, pa.array(r["run"])], [x.split()[0] for x in ENTRIES.split(", ")])

    return docs.mapInArrow(build, ENTRIES)


class SuffixFamily:
    """The levels of the index: (suffix, run, n) in order of suffixes, each a table in the shared folder, with a rank."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.made = scratch, [], 0

    def _save(self, array: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"level-{self.made}"
        return name, self.scratch.save(array.sortWithinPartitions("suffix", "run"), name)

    def _merge(self) -> None:
        """Merge levels of one rank. An entry stands once in each, so they are dealt out by ranges before equal ones are added up."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, name, level), (_, other, before) = self.levels.pop(), self.levels.pop()
            both = before.unionAll(level).repartitionByRange("suffix", "run").groupBy("suffix", "run").agg(F.sum("n").alias("n"))
            self.levels.append((rank + 1, *self._save(both)))
            self.scratch.drop(other, name)

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch of entries. Returns the suffixes that match inside the batch or between it and earlier ones. After the `last` one levels stay as they are."""
        name, array = self._save(batch.groupBy("suffix", "run").agg(F.count("*").alias("n")).repartitionByRange("suffix", "run"))
        own = array.groupBy("suffix").agg(F.sum("n").alias("n"))
        matches = own.filter("n > 1").select("suffix")
        for _, _, level in self.levels:  # both sides in order: a merge scan
            matches = matches.unionAll(level.select("suffix").join(own.select("suffix").hint("merge"), "suffix"))
        matches = self.scratch.save(matches.distinct(), f"matches-{self.made}")
        self.levels.append((0, name, array))
        if not last:
            self._merge()
        return matches

    def lookup(self, suffixes: DataFrame) -> DataFrame:
        """(suffix, run, n) of all levels for `suffixes`."""
        found = None
        for _, _, level in self.levels:
            part = level.join(suffixes.hint("merge"), "suffix", "left_semi")
            found = part if found is None else found.unionAll(part)
        return found.groupBy("suffix", "run").agg(F.sum("n").alias("n"))


def _window_marks(contexts: list[bytes], n: np.ndarray, anchor: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, number and fingerprint of each window of each context; the fingerprint knows the context's group and where the anchor is."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum([0, *map(len, contexts)])[:-1]
    which = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + number
    marks = spans(prefix_sums(data), at, at + LENGTH)
    place = (anchor[which] - number).astype(np.uint64)
    return which, number, mix(marks ^ mix(group[which].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place * np.uint64(0x9E3779B97F4A7C15)))


def _as_spans(number: np.ndarray) -> list[int]:
    """Begins and ends, in bytes from the run's first window, of what sorted windows cover."""
    cut = np.flatnonzero(np.diff(number) > LENGTH) + 1
    return [x for part in np.split(number, cut) for x in (int(part[0]), int(part[-1]) + LENGTH)] if len(number) else []


CONTEXT = "suffix binary, run long, n int, anchor int, context binary"
SPANS = "suffix binary, run long, spans array<int>"


def _starts(suffix: pa.Array) -> np.ndarray:
    """Whether each of the suffixes, in order, differs from the one before."""
    new = np.ones(len(suffix), bool)
    if len(suffix) > 1:
        new[1:] = pc.not_equal(suffix[1:], suffix[:-1]).to_numpy(zero_copy_only=False)
    return new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of suffixes: (suffix, run, spans) of those that share windows with another run of the suffix."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        suffix, n = t["suffix"].combine_chunks(), t["n"].to_numpy().astype(np.int64)
        which, number, marks = _window_marks(t["context"].to_pylist(), n, t["anchor"].to_numpy().astype(np.int64), np.cumsum(_starts(suffix)))
        _, back, count = np.unique(marks, return_inverse=True, return_counts=True)
        shared = count[back] > 1
        which, number = which[shared], number[shared]
        found = np.unique(which)
        parts = np.split(number, np.searchsorted(which, found[1:])) if len(found) else []
        return pa.RecordBatch.from_arrays([suffix.take(pa.array(found)), pa.array(t["run"].to_numpy()[found]), pa.array([_as_spans(p) for p in parts], pa.list_(pa.int32()))], ["suffix", "run", "spans"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= STREAM_ROWS:
            cut = int(np.flatnonzero(_starts(held["suffix"].combine_chunks()))[-1])  # the last suffix may go on
            if cut:
                yield solve(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held.combine_chunks())


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        run, n = batch["run"].to_numpy(), batch["n"].to_numpy().astype(np.int64)
        which, number, marks = _window_marks(batch["context"].to_pylist(), n, batch["anchor"].to_numpy().astype(np.int64), np.zeros(len(n), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(signed(marks)), batch["suffix"].take(pa.array(which)), pa.array(run[which]), pa.array(number.astype(np.int32))], ["mark", "suffix", "run", "number"])


def partial_matches(contexts: DataFrame, stream_runs: int = STREAM_RUNS) -> DataFrame:
    """(suffix, run, spans) of runs that share windows with other runs of their suffix, from (suffix, run, n, anchor, context, kinds)."""
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    few = contexts.filter(F.col("kinds") <= stream_runs).select(*names).repartition("suffix").sortWithinPartitions("suffix")
    few = few.mapInArrow(_compare, SPANS)
    windows = contexts.filter(F.col("kinds") > stream_runs).select(*names).mapInArrow(_explode_windows, "mark long, suffix binary, run long, number int")
    shared = windows.groupBy("suffix", "mark").agg(F.count("*").alias("c")).filter("c > 1").select("suffix", "mark")
    spread = windows.join(shared, ["suffix", "mark"]).groupBy("suffix", "run").agg(F.array_sort(F.collect_list("number")).alias("numbers"))  # at most a run's windows

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_as_spans(np.array(x, np.int64)) for x in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["suffix", "run", "spans"])

    return few.unionAll(spread.mapInArrow(spans_of, SPANS))


def _cut(text: bytes, found: list | None) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, maximal removed runs, and what remains."""
    n_spans = removed = at = 0
    kept = []
    for low, high in sorted((x["low"], x["high"]) for x in found or ()):
        if high <= at and n_spans:
            continue
        if n_spans == 0 or low > at:
            n_spans += 1
            kept.append(text[at:low])
            removed += high - low
        else:
            removed += high - at
        at = high
    kept.append(text[at:])
    return len(text), removed, n_spans, b"".join(kept)


def repeated_spans(docs: DataFrame, batches: int, scratch: Scratch, stream_runs: int = STREAM_RUNS) -> DataFrame:
    """(key, found): the byte spans to remove from each text; spans may overlap. `docs` has doc_id, text and key, that of the row."""
    part = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(batches))
    all_entries = scratch.save(entries(docs.select("doc_id", "key", "text")), "entries")
    family, matches = SuffixFamily(scratch), None
    for k in range(batches):
        found = family.add(all_entries.filter(part == k), last=k == batches - 1)
        matches = found if matches is None else matches.unionAll(found)
    runs_found = family.lookup(matches.distinct())
    kinds = runs_found.groupBy("suffix").agg(F.count("*").alias("kinds"))
    flagged = runs_found.join(kinds.hint("merge"), "suffix").filter("n > 1 or kinds > 1")
    flagged = scratch.save(flagged.select("suffix", "run", (F.col("n") > 1).alias("whole"), "kinds"), "flagged")
    scratch.drop(*(name for _, name, _ in family.levels))
    hits = scratch.save(all_entries.join(flagged, ["suffix", "run"]), "hits")
    scratch.drop("entries", "flagged")
    one = hits.filter("kinds > 1").groupBy("suffix", "run").agg(F.first("kinds").alias("kinds"), F.min(F.struct("key", "first", "n", "anchor")).alias("r"))
    one = one.select("suffix", "run", "kinds", "r.*")
    both = docs.select("key", "text").join(one, "key")
    context = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("n") + LENGTH - 1)
    contexts = scratch.save(both.select("suffix", "run", "n", "anchor", "kinds", context.alias("context")).dropDuplicates(["suffix", "run"]), "contexts")
    partial = scratch.save(partial_matches(contexts, stream_runs), "partial")
    scratch.drop("contexts")
    whole = hits.filter("whole").select("key", F.struct(F.col("first").alias("low"), (F.col("first") + F.col("n") + LENGTH - 1).alias("high")).alias("span"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("first") + F.get("spans", i)).alias("low"), (F.col("first") + F.get("spans", i + 1)).alias("high")))
    some = hits.filter("not whole").join(partial.filter("size(spans) > 0"), ["suffix", "run"]).select("key", F.explode(pairs).alias("span"))
    return whole.unionAll(some).distinct().groupBy("key").agg(F.collect_list("span").alias("found"))


def remove_repeats(docs: DataFrame, batches: int = 4, with_text: bool = False, stream_runs: int = STREAM_RUNS) -> DataFrame:
    """Remove from each text of (doc_id, text) all bytes that a repeated string of LENGTH bytes covers.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with `with_text` also
    `kept`, the remaining bytes. A null text is empty. Repeated rows lose what they share. An empty table gives
    an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    found = scratch.save(repeated_spans(docs, batches, scratch, stream_runs), "found")
    scratch.drop("hits", "partial")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(t, f) for t, f in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            numbers = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, digests, *([pa.array([x[3] for x in out], pa.binary())] if with_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    joined = docs.join(found, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
