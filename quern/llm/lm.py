"""Language-model scores by a probabilistic suffix tree over words.

A node is a context: some successive words (the start of a text counts as one). As in Ron, Singer and Tishby (1996) it is
retained if the distribution of its next words diverges from that of its parent, the context without its first word; a token's
state is its longest suffix in the tree. Contexts are lengthened as long as any is left, so their length varies. A node's counts are discounted
and the rest of the mass goes to the parent's distribution:

    P(x | context) = max(c(context x) - DISCOUNT, 0) / c(context) + DISCOUNT * kinds / c(context) * P(x | parent)

The root is the smoothed distribution of words, P(x) = (c + 0.5) / (N + 0.5 (V + 1)), of which every training token counts.

The tree has two parts, by the last word of a context.
* Frequent words, with a share of MIN_WORD of all tokens: each is a context, whose next words are those frequent ones that follow it with a share of MIN_PAIR
  of all tokens, and at least twice; with such a word it is a longer context. Retained are those with a divergence of MIN_DIVERGENCE nats. The tables are bounded by
  the shares (at most 2 million words and contexts and 5 million pairs a length) and broadcast. Each length takes a pass over the texts, so `longest` bounds it.
* All rarer words, whose number grows with the corpus: contexts that end with one are counted whatever their share, and retained if the next
  words, each predicted from the others (leave-one-out), are likelier than at the parent by MIN_GAIN nats in all. These tables grow with the corpus: they
  are made and joined to the texts by shuffles, one length at a time; only places whose shorter contexts were all retained go on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, as_bytes, fold, read

#: Shares of all training tokens: of a word that is broadcast, a next word in the tree, a context, and a context with its next word.
MIN_WORD, MIN_NEXT, MIN_CONTEXT, MIN_PAIR = 5e-7, 5e-7, 5e-7, 2e-7
MIN_DIVERGENCE, MIN_GAIN, DISCOUNT = 0.02, 2.0, 0.5
#: Distinct words a task counts before it passes its counts on, and bytes of text that are looked up together.
FLUSH, GROUP = 400_000, 1 << 19


def split(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case. bytes.split() cuts at ASCII white space and bytes.lower() changes ASCII only."""
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            counts.update(split(text))
        if len(counts) > FLUSH:
            yield out()
            counts = Counter()
    yield out()


class Words:
    """Frequent words by number, most frequent first; the end of a text and its start have the two numbers after them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_texts: int, total: int, distinct: int, min_next: float, min_context: float):
        self.number = {w: i for i, w in enumerate(words)}
        self.end, self.start = len(words), len(words) + 1
        self.counts = np.append(counts, n_texts).astype(np.float64)
        self.total, self.distinct = total, distinct
        self.base = (self.counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.is_next = np.append(self.counts >= min_next * total, False)
        self.is_context = np.append(self.counts >= min_context * total, True)
        self.is_context[self.end] = False
        self.size = len(words) + 2

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a text's words and its end, with its start before them; -1 for rarer words."""
        return self.all_numbers([words])[0]

    def all_numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The same of several texts, one after another, and where each begins. No context reaches into another text, since an end is none."""
        size = np.array([len(t) + 2 for t in texts], np.int64)
        ends = np.cumsum(size)
        out = np.empty(ends[-1], np.int64)
        inner = np.ones(len(out), bool)
        for at, number in ((ends - size, self.start), (ends - 1, self.end)):
            out[at], inner[at] = number, False
        out[inner] = np.fromiter(map(self.number.get, chain.from_iterable(texts), repeat(-1)), np.int64, len(out) - 2 * len(texts))
        return out, ends - size


def _groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of successive texts, of about GROUP bytes together."""
    held, size = [], 0
    for text in texts:
        held.append(split(text))
        size += len(text)
        if size > GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Level:
    """Contexts of one length, as hash tables: code of each (place of the context without its last word in the level before, and that word), what goes back to
    the parent (NaN: not retained), and the next words: code of context and word, discounted share."""

    codes: pd.Index
    back: np.ndarray
    pairs: pd.Index
    share: np.ndarray

    def shares(self, size: int, places: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        at = self.pairs.get_indexer(places * size + nexts)
        out = np.zeros(len(at))
        out[at >= 0] = self.share[at[at >= 0]]
        return out


def places(words: Words, levels: list[Level], x: np.ndarray) -> list[np.ndarray]:
    """For each length, the context that ends with each token; -1 for none."""
    out: list[np.ndarray] = []
    for k, level in enumerate(levels):
        before = np.append(-1, out[-1][:-1]) if k else np.zeros(len(x), np.int64)
        ask = np.flatnonzero((x >= 0) & (before >= 0))
        at = np.full(len(x), -1)
        at[ask] = level.codes.get_indexer(before[ask] * words.size + x[ask])
        out.append(at)
    return out


def states(words: Words, levels: list[Level], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token after the first: its probability (of a rare word, the factor of its probability at the root; of a start nothing of use) and whether it is rare."""
    nexts = x[1:]
    rare = nexts < 0
    p = np.where(rare, 1.0, words.base[np.minimum(nexts, words.end)])
    for level, at in zip(levels, places(words, levels, x[:-1]), strict=True):
        held = np.flatnonzero(at >= 0)
        held = held[~np.isnan(level.back[at[held]])]
        p[held] *= level.back[at[held]]
        held = held[~rare[held]]
        p[held] += level.shares(words.size, at[held], nexts[held])
    return p, rare


def _at_parent(words: Words, levels: list[Level], spelled: np.ndarray, place: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Probability of next words after all words but the first of a context, the row `place` of `spelled`."""
    p = words.base[nexts]
    for length, level in enumerate(levels, 1):
        at = np.zeros(len(spelled), np.int64)
        for below, word in zip(levels[:length], spelled[:, -length:].T, strict=True):
            at = np.where(at >= 0, below.codes.get_indexer(at * words.size + word), -1)
        back = np.append(level.back, np.nan)[at[place]]
        p = np.where(np.isnan(back), p, level.shares(words.size, at[place], nexts) + back * p)
    return p


def _retain(words: Words, codes: np.ndarray, totals: np.ndarray, pairs: np.ndarray, counts: np.ndarray, parent: np.ndarray) -> Level:
    """A level from its contexts (sorted codes, counts) and their next words (place * size + word, sorted); `parent` is each one's probability at the parent."""
    place = pairs // words.size
    p = counts / totals[place]
    rest, parent_rest = np.ones(len(codes)), np.ones(len(codes))
    np.subtract.at(rest, place, p)
    np.subtract.at(parent_rest, place, parent)
    rest, parent_rest = np.clip(rest, 1e-12, 1), np.clip(parent_rest, 1e-12, 1)
    divergence = np.bincount(place, p * np.log(p / parent), len(codes)) + rest * np.log(rest / parent_rest)
    share = (counts - DISCOUNT) / totals[place]
    back = np.ones(len(codes))
    np.subtract.at(back, place, share)
    return Level(pd.Index(codes), np.where(divergence >= MIN_DIVERGENCE, back, np.nan), pd.Index(pairs), share)


def _count_codes(docs: DataFrame, codes_of: Callable[[list[list[bytes]]], np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur at least `least` times over all texts, sorted, and their counts. `codes_of` gives the codes of the words of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            if not len(codes):
                return new, times
            both, order = np.concatenate([codes, new]), np.concatenate([n, times])
            by = np.argsort(both, kind="stable")  # two sorted parts: merged
            both, order = both[by], order[by]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            return both[first], np.add.reduceat(order, first)

        for batch in batches:
            for texts in _groups(as_bytes(batch.column(0))):
                held.append(codes_of(texts))
                size += len(held[-1])
            if size > 1 << 21:
                codes, n = counted()
                held, size = [], 0
                if len(codes) > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])
                    codes, n = codes[:0], n[:0]
        codes, n = counted()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    counted = docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counted.toArrow()
    codes, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order].astype(np.float64)


def learn(train: DataFrame, scratch: Scratch, longest: int = 3) -> tuple[DataFrame, Words, list[Level]]:
    """Count the words of (text) and grow the part of the tree that ends with frequent words: all word counts, the frequent words, and a level for each length up to `longest`; each takes a pass over the texts."""
    spark = train.sparkSession
    counts = scratch.save(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n_texts = train.count()
    total, distinct = (total or 0) + n_texts, distinct + (n_texts > 0)
    frequent = counts.filter(F.col("n") >= max(1.0, MIN_WORD * total)).toArrow()  # at most 1 / MIN_WORD rows
    order = sorted(zip(frequent["n"].to_pylist(), frequent["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    words = Words([w for _, w in order], np.array([n for n, _ in order]), n_texts, total, distinct, MIN_NEXT, MIN_CONTEXT)
    levels: list[Level] = []
    # contexts of the next length (sorted codes), their counts, and their words
    codes = np.flatnonzero(words.is_context) if n_texts else np.zeros(0, np.int64)
    totals, spelled = np.append(words.counts, n_texts)[codes], codes[:, None]
    while len(codes) and len(levels) < longest:
        shared = spark.sparkContext.broadcast((words, [*levels, Level(pd.Index(codes), np.full(len(codes), np.nan), pd.Index(np.zeros(0, np.int64)), np.zeros(0))]))

        def pairs_of(texts: list[list[bytes]], shared=shared) -> np.ndarray:
            w, below = shared.value
            x, _ = w.all_numbers(texts)
            at, nexts = places(w, below, x[:-1])[-1], x[1:]
            keep = (at >= 0) & (nexts >= 0) & w.is_next[np.minimum(nexts, w.end)]
            return at[keep] * w.size + nexts[keep]

        pairs, n = _count_codes(train, pairs_of, max(2.0, MIN_PAIR * total))
        shared.destroy()
        if not len(pairs):
            break
        place, nexts = pairs // words.size, pairs % words.size
        levels.append(_retain(words, codes, totals, pairs, n, _at_parent(words, levels, spelled, place, nexts)))
        often = (n >= MIN_CONTEXT * total) & words.is_context[nexts]
        codes, totals, spelled = pairs[often], n[often], np.concatenate([spelled[place[often]], nexts[often, None]], axis=1)
    return counts, words, levels


#: Words before the last one that a context of the second part may have.
BEFORE = 8
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, context array<long>, next array<long>, word array<binary>, p array<double>, before array<array<long>>"


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _scores(w: Words, levels: list[Level], log_base: np.ndarray, texts: list[list[bytes]]) -> list[pa.Array]:
    """Of each text: tokens, known ones, log10 of its probability at the root and by the first part of the tree (rare words left out), the rare words, and the places
    after them: mark of the word and of what follows, that if it is rare, else its probability at the root, and the marks before the word, nearest first.

    A mark is the number of a frequent word, the start or the end, and a hash of 63 bits below zero of a rare word.
    """
    x, begins = w.all_numbers(texts)
    p, rare = states(w, levels, x)
    start = x == w.start
    log = np.zeros(len(x))
    log[1:] = np.log10(p)
    log[start] = 0
    seen = np.flatnonzero((x >= 0) & ~start)
    base, known = np.zeros(len(x)), np.zeros(len(x), np.int64)
    base[seen], known[seen] = log_base[x[seen]], w.counts[x[seen]] > 0
    at = np.flatnonzero(x < 0)
    row = np.searchsorted(begins, at, side="right") - 1
    words = list(chain.from_iterable(texts))
    names = [words[i] for i in (at - 2 * row - 1).tolist()]
    marks = x.copy()
    marks[at] = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(at)).view(np.int64) | np.int64(-1 << 63)
    y = x[at + 1]
    nexts = pa.array([words[i] if i >= 0 else None for i in np.where(y < 0, at - 2 * row, -1).tolist()], pa.binary())
    back = at[:, None] - np.arange(1, BEFORE + 1)
    inside = back >= begins[row][:, None]
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    own = [pa.array(np.diff(np.append(begins, len(x))) - 1), *(pa.array(np.add.reduceat(v, begins)) for v in (known, base, log))]
    places = [pa.array(marks[at]), pa.array(marks[at + 1]), nexts, pa.array(w.base[np.maximum(y, 0)] if len(at) else np.zeros(0), mask=y < 0), _lists(np.cumsum(inside.sum(1)), pa.array(marks[np.maximum(back, 0)][inside]))]
    return [*own, *(_lists(ends, v) for v in [pa.array(names, pa.binary()), *places])]


def _scoring(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score texts by the first part of the tree; what the rest needs goes along: rare words, and the places after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, levels = shared.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        log_base = np.log10(w.base)
        for batch in batches:
            done = 0
            for texts in _groups(as_bytes(batch.column(1))):
                ids, held = batch.column(0).slice(done, len(texts)), batch.column(2).slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), ids, held, *_scores(w, levels, log_base, texts)], [c.split()[0] for c in SCORED.split(", ")])
                row, done = row + len(texts), done + len(texts)

    return run


def grown(after: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(row, gain): what the second part of the tree adds to the log10 probability of each text, from (row, held_out, context, next, p, before).

    A row of `after`, the table of that name in `scratch`, is a token whose state so far is the root, where it has probability p. Each round makes the contexts of one more word.
    """
    scratch.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # the second join reads what the first one dealt out
    at, held, gains, k = after, "after", None, 0
    while not at.isEmpty():
        # contexts end with words that are rare, so few training places share one: they are dealt out by it once
        pairs = at.filter("not held_out").select("context", "next", "p").repartition("context").groupBy("context", "next").agg(F.count("*").alias("n"), F.max("p").alias("p"))
        own = Window.partitionBy("context")
        pairs = pairs.withColumns({"c": F.sum("n").over(own), "kinds": F.count("*").over(own)}).filter("c > 1")
        n, c, kinds = F.col("n"), F.col("c"), F.col("kinds")
        again = n * F.log((n - 1 - DISCOUNT) / (c - 1) / F.col("p") + DISCOUNT * kinds / (c - 1))
        once = F.log(DISCOUNT * (kinds - 1) / (c - 1))
        pairs = pairs.withColumn("gain", F.sum(F.when(n > 1, again).otherwise(once)).over(own)).filter(F.col("gain") >= MIN_GAIN)
        pairs = scratch.save(pairs.withColumn("first", F.col("next") == F.min("next").over(own)).select("context", "next", "n", "c", "kinds", "first"), f"pairs-{k}")
        kept = pairs.filter("first").select("context", "c", "kinds")
        now = at.join(kept.hint("merge"), "context").join(pairs.select("context", "next", "n").hint("merge"), ["context", "next"], "left")
        q = F.greatest(F.coalesce("n", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("c") + DISCOUNT * F.col("kinds") / F.col("c") * F.col("p")
        now = scratch.save(now.select("row", "held_out", "context", "next", q.alias("p"), F.log10(q / F.col("p")).alias("gain"), "before"), f"now-{k}")
        scratch.drop(held, f"pairs-{k}")
        gains = scratch.append(now.groupBy("row").agg(F.sum("gain").alias("gain")), "gains")
        longer = F.xxhash64("context", F.get("before", F.lit(k)))
        at, held = now.filter(F.size("before") > k).select("row", "held_out", longer.alias("context"), "next", "p", "before"), f"now-{k}"
        k += 1
    scratch.drop(held)
    return None if gains is None else gains.groupBy("row").agg(F.sum("gain").alias("gain"))


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, longest: int = 3) -> DataFrame:
    """Score each text of (doc_id, text) by a tree learned from the texts outside the held-out fold.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (those seen in training), train_tokens,
    base_score (the root alone) and score, both log10 of the text's probability. A null text is empty: just
    its end. `longest` bounds the contexts that end with a frequent word, not those that end with a rare one. A null doc_id counts as the empty id. Repeated rows are scored alike and count alike. Without
    training texts the one smoothed probability is 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    counts, words, levels = learn(docs.filter(~F.col("held_out")).select("text"), scratch, longest)
    shared = spark.sparkContext.broadcast((words, levels))
    scored = scratch.save(docs.mapInArrow(_scoring(shared), SCORED), "scored")
    shared.destroy()
    below = counts.filter(F.col("n") < max(1.0, MIN_WORD * words.total))
    mass = words.total + 0.5 * (words.distinct + 1)
    each = scored.select("row", F.explode("rare").alias("word"))
    rare = each.join(below, "word", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(mass))).alias("log"),
        F.count("n").alias("more"),
    )
    rare = scratch.save(rare, "rare")
    texts = scratch.save(scored.drop("rare", "context", "next", "word", "p", "before"), "texts")
    after = scored.select("row", "held_out", F.inline(F.arrays_zip("context", "next", "word", "p", "before")))
    known, unknown = after.filter("word is null").drop("word"), after.filter("word is not null")
    unknown = unknown.join(below, "word", "left").withColumn("p", (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(mass))
    after = scratch.save(known.unionByName(unknown.drop("word", "n")), "after")
    scratch.drop("scored", "counts")  # the places are in one table at a time
    gains = grown(after, scratch)
    gains = rare.select("row", F.lit(0.0).alias("gain")).limit(0) if gains is None else scratch.save(gains, "gain")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    out = texts.join(rare, "row", "left").join(gains, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log + F.coalesce("gain", F.lit(0.0))).alias("score")
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
