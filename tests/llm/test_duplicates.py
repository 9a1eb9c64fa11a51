"""Suffix-array removal, n-gram join, line deduplication and the pipeline, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import line_dedup, ngram_join, similar, suffix_dedup
from quern.llm.common import Scratch, read
from quern.llm.similar import components


def near(text: str, rng: random.Random, share: float) -> str:
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(odd):
    """Copies, near copies at several distances, shared passages, repeated bytes, odd rows."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["ba", "ko", "li", "tu"]) + rng.choice("xyzvw") * rng.randint(1, 3) + str(rng.randrange(60)) for _ in range(n))
    base = [say(rng.randint(20, 200)) for _ in range(12)]
    rows = [(100 + k, t) for k, t in enumerate(base)]
    rows += [(200 + k, base[k % 4]) for k in range(12)]
    rows += [(300 + k, near(base[k % 6], rng, rng.choice([0.005, 0.01, 0.02, 0.04]))) for k in range(40)]
    shared = say(60)
    rows += [(400 + k, say(30) + "\n" + shared + "\n" + say(15)) for k in range(15)]
    rows += [(500, "ab" * 400), (501, "ab" * 150 + say(40)), (502, say(10) + "z" * 700), (503, base[7][10:400] + base[8][5:300])]
    rows += [(600 + k, near(base[0], rng, 0.01) + "\n" + say(8)) for k in range(10)]
    return rows + [(i, t) for i, t in odd if i not in (6, 7)]


def brute_removal(texts: list[bytes], length: int):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                low = max(i, end)
                end = i + length
                gone[low:end] = b"\1" * (end - low)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        yield len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("batches,stream_runs", [(4, 4096), (3, 1), (1, 2)])
def test_suffix_removal(documents, corpus, batches, stream_runs):
    want = collections.Counter(zip([i for i, _ in corpus], brute_removal([(t or "").encode() for _, t in corpus], 200), strict=True))
    got = suffix_dedup.remove_repeats(documents(corpus, extra=True), batches, with_text=True, stream_runs=stream_runs).collect()
    assert collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_levels_are_geometric(spark):
    family = suffix_dedup.SuffixFamily(Scratch(spark, "test"))
    ranks = []
    for k in range(7):
        family.add(spark.createDataFrame([(bytes([k]), 0), (b"c", k)], "suffix binary, run long"))
        ranks.append([r for r, _, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    assert {(r.run, r.n) for r in family.lookup(spark.createDataFrame([(b"c",)], "suffix binary")).collect()} == {(k, 1) for k in range(7)}


def test_last_batch_rewrites_nothing(spark):
    """Nothing is added after the last batch, so no level is merged then; a lookup adds up what stands in several."""
    family = suffix_dedup.SuffixFamily(Scratch(spark, "test"))
    for k in range(4):
        found = family.add(spark.createDataFrame([(bytes([k]), 0), (b"c", k % 2)], "suffix binary, run long"), last=k == 3)
    assert {bytes(r.suffix) for r in found.collect()} == {b"c"}
    assert [r for r, _, _ in family.levels] == [1, 0, 0] and family.made == 5
    assert {(r.run, r.n) for r in family.lookup(spark.createDataFrame([(b"c",)], "suffix binary")).collect()} == {(0, 2), (1, 2)}


@pytest.mark.parametrize("copies", [20, 40])
def test_windows_grow_with_the_copies(documents, copies):
    """A group of near copies gives no more rows of windows than its texts have windows."""
    rng = random.Random(copies)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(f"edit{rng.randrange(10**9)}" if rng.random() < 0.03 else w for w in base) for _ in range(copies)]
    windows = sum(len(t) - suffix_dedup.LENGTH + 1 for t in texts)
    made = []
    for t in texts:
        r = suffix_dedup.runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        contexts = [t.encode()[a : a + n + suffix_dedup.LENGTH - 1] for a, n in zip(r["first"], r["n"], strict=True)]
        made.append(pa.RecordBatch.from_arrays([pa.array([b""] * len(contexts), pa.binary()), pa.array(r["run"]), pa.array(r["n"].astype(np.int32)), pa.array(r["anchor"].astype(np.int32)), pa.array(contexts, pa.binary())], ["suffix", "run", "n", "anchor", "context"]))
    assert sum(b.num_rows for b in suffix_dedup._explode_windows(iter(made))) == windows


def test_levels_are_suffix_arrays(spark, documents, corpus):
    """A level holds the suffixes at anchors in the order of their bytes, over all its files; each stands in a text, and every window has one."""
    docs = documents(corpus).selectExpr("doc_id", "doc_id as key", "text")
    family = suffix_dedup.SuffixFamily(Scratch(spark, "test"))
    found = suffix_dedup.entries(docs).collect()
    family.add(suffix_dedup.entries(docs))
    files = [f.path for f in spark.read.format("binaryFile").load(family.scratch.path("level-1")).select("path").orderBy("path").collect() if "/part-" in f.path]
    order = [bytes(r.suffix) for f in files for r in spark.read.parquet(f).collect()]
    assert order == sorted(order) and set(order) == {bytes(r.suffix) for r in found}
    texts = {i: (t or "").encode() for i, t in corpus}
    covered = collections.Counter()
    for r in found:
        at = r.first + r.anchor
        if r.doc_id not in (8, None):
            assert texts[r.doc_id][at : at + suffix_dedup.GRAM] == bytes(r.suffix)
            covered[r.doc_id] += r.n
    assert all(covered[i] == max(0, len(t) - suffix_dedup.LENGTH + 1) for i, t in texts.items() if i not in (8, None))


def shingle_set(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    u = Union()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                u.join(i, j)
    return {i: (len(a), u.find(i)) for i, a in sets}


def test_ngram_join(documents, corpus):
    got = ngram_join.similar_documents(documents(corpus, extra=True)).collect()
    assert len(got) == len(corpus)
    want = brute_groups(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    kept = ngram_join.one_of_each(documents(corpus, extra=True))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _ in corpus if i is not None and want[i][1] == i})
    assert ngram_join.similar_documents(documents([])).count() == 0


def test_ngram_join_at_the_bound(documents):
    """Sets that meet 0.8 exactly are linked, those just below are not."""
    words = [f"q{k}" for k in range(94)]  # 90 shingles
    ten = words[:84] + [f"r{k}" for k in range(10)]  # 80 shared of 100
    eleven = words[:83] + [f"s{k}" for k in range(11)]  # 79 shared of 101
    rows = [(1, " ".join(words)), (2, " ".join(ten)), (3, " ".join(eleven))]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(documents(rows)).collect()}
    assert got == {i: v[1] for i, v in brute_groups(rows).items()} == {1: 1, 2: 1, 3: 3}


def test_chain_of_near_copies(documents):
    """A chain whose ends are not alike is one component."""
    words = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(13)]
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(documents(rows)).collect()} == {i: v[1] for i, v in brute_groups(rows).items()}


def test_ngram_join_through_null_ids(documents):
    """Documents without an id link others, and each other."""
    words = [f"c{k}" for k in range(100)]
    rows = [(1, " ".join(words[:60])), (None, " ".join(words[6:66])), (None, " ".join(words[6:66])), (2, " ".join(words[12:72]))]
    rows += [(None, " ".join(f"d{k}" for k in range(x, x + 60))) for x in (0, 3)]
    got = ngram_join.similar_documents(documents(rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (2, 1)]


def test_one_of_each_row(documents):
    """A row given twice stays once; rows of one doc_id with different texts are different documents; null ids come last."""
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, "unique words of its own, not found anywhere else"), (1, long), (2, long), (2, long), (None, long), (None, "no id but unique words in this text"), (None, None), (3, ""), (4, "given twice as it is, word by word"), (4, "given twice as it is, word by word")]
    got = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(documents(rows, extra=True)).collect())
    assert got == sorted([(1, rows[0][1]), (1, long), (0, rows[5][1]), (0, ""), (3, ""), rows[8]])


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 60)], [(k, (k * 7) % 40) for k in range(40)] + [(100, 101)]])
def test_components(spark, edges):
    u = Union()
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.root for r in components(df, Scratch(spark, "test"), "c").collect()}
    groups = collections.defaultdict(set)
    for i, r in got.items():
        groups[r].add(i)
    want = collections.defaultdict(set)
    for i in {x for e in edges if e[0] != e[1] for x in e}:
        want[u.find(i)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def normal_line(raw: str) -> str:
    return raw.replace("\t", " ").replace("\r", " ").lower().strip(" ")


def line_shingles(line: str) -> set:
    n = line_dedup.SHINGLE
    return {line[k : k + n] for k in range(len(line) - n + 1)} if len(line) >= n else {line}


def similar_lines(x: set, y: set) -> bool:
    return min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))


def brute_lines(rows):
    """Places (doc_id, line number) of the lines to remove, and those of them that have no exact copy. Ids don't repeat."""
    lines = collections.defaultdict(list)
    for i, t in rows:
        for k, raw in enumerate((t or "").split("\n")):
            if line := normal_line(raw):
                lines[line].append((1 << 63 if i is None else i, k))
    sets = {x: line_shingles(x) for x in lines}
    u = Union()
    seen: list[str] = []
    for x in lines:
        for y in seen:
            if similar_lines(sets[x], sets[y]):
                u.join(x, y)
        seen.append(x)
    groups = collections.defaultdict(list)
    for x, places in lines.items():
        groups[u.find(x)] += places
    removed = {p for places in groups.values() for p in places if p != min(places)}
    return removed, {places[0] for places in lines.values() if len(places) == 1} & removed


def removed_places(docs):
    return {(1 << 63 if r.doc_id is None else r.doc_id, k) for r in line_dedup.line_report(docs).collect() for k in r.removed}


@pytest.mark.parametrize("whole", [True, False])
def test_cells_of_a_bucket(spark, monkeypatch, whole):
    """Members and leaders of a bucket meet in cells of bounded size, each pair in one."""
    monkeypatch.setattr(similar, "CELL", 40)
    sizes = {1: 500, 2: 30, 3: 41}
    rows = spark.createDataFrame([(b, 1000 * b + k, n) for b, n in sizes.items() for k in range(n)], "bucket long, id long, size long")
    lead = rows.filter(F.lit(True) if whole else F.col("id") % 1000 < 16).withColumnRenamed("id", "to")
    pairs = similar.meeting(rows, lead, whole)
    got = [(r.bucket, r.id, r.to) for r in pairs.collect()]
    assert len(got) == len(set(got)) == sum(n * (n if whole else min(n, 16)) for n in sizes.values())
    assert max(r["count"] for r in pairs.groupBy("bucket", "cell", "cell2").count().collect()) < 3 * 40 * (40 if whole else 16)


@pytest.mark.parametrize("per_row", [1, 10_000])
def test_links_in_one_bucket(spark, monkeypatch, per_row):
    """One bucket with very many components: by leaders to the end, and by all pairs in cells."""
    monkeypatch.setattr(similar, "CELL", 64)
    monkeypatch.setattr(similar, "SIFTED_PER_ROW", per_row)
    n = 900
    live = spark.range(n).selectExpr("1L AS bucket", "id", "named_struct('n', 1) AS x").unionAll(spark.range(5).selectExpr("2L", "id + 890", "named_struct('n', 1)"))
    alike = lambda pairs: pairs.filter("a div 3 = b div 3 or a + b = 1795")
    roots = {r.id: r.root for r in similar.linked(live, alike, lambda x, y: F.lit(True), Scratch(spark, "linked")).collect()}
    groups = collections.defaultdict(set)
    for i in range(n):
        groups[roots[i]].add(i)
    want = [{3 * k, 3 * k + 1, 3 * k + 2} for k in range(n // 3)]
    joined = [g for g in want if g & {896, 899}]
    want = [g for g in want if g not in joined] + [set().union(*joined)]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_lines(documents, corpus):
    rows = [(i, t) for i, t in corpus if i != 8]  # repeated ids are tested below
    docs = documents(rows, extra=True)
    got = removed_places(docs)
    want, near_copies = brute_lines(rows)
    assert got <= want and len(near_copies - got) <= 0.02 * len(near_copies) and len(near_copies) > 20  # banding may miss a pair at the bound
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in rows:
        assert out[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (1 << 63 if i is None else i, k) not in got))
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_lines_of_repeated_ids(documents):
    """Rows of one doc_id with different texts are different documents; a row given twice is one."""
    rows = [(1, "unique alpha text in row a\nshared line of many"), (1, "another text in row b\nshared line of many"), (1, "another text in row b\nshared line of many"), (2, "shared line of many\nnew"), (None, "new\nonly here")]
    out = sorted((r.doc_id or 99, r.text, r.n_chars) for r in line_dedup.dedup_lines(documents(rows)).collect())
    ones = [t for i, t, _ in out if i == 1]
    assert len(out) == len(rows) and [x for x in out if x[0] != 1] == [(2, "new", 3), (99, "only here", 9)]
    assert ("unique alpha text in row a" in ones) != ("unique alpha text in row a\nshared line of many" in ones)
    assert sum("shared line of many" in t for t in set(ones)) == 1 and len(set(ones)) == 2


def test_prefixes_of_a_large_group(spark):
    """Lines of one large group with many edits each share no rare shingle: rows of prefixes grow with the lines, not with the square of the group. Each pair of similarity 0.8 shares one that lies early enough in both."""
    rng = random.Random(21)
    template = [f"{rng.randrange(10**6)}" for _ in range(60)]
    edited = lambda n: " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6)) if k in at else w for at in [rng.sample(range(60), n)] for k, w in enumerate(template))
    lines = [edited(1) for _ in range(20)] + [edited(2) for _ in range(20)] + [edited(20) for _ in range(300)]
    text = spark.createDataFrame(list(enumerate(lines)), "id long, line string").select("id", line_dedup.tokens(F.col("line")).alias("tokens"))
    rows = line_dedup.prefixes(text.select("id", F.size("tokens").alias("n"), "tokens"), Scratch(spark, "test")).collect()
    assert len({r.id for r in rows if r.id >= 40}) < 15  # they meet nobody, but for chance
    buckets = collections.defaultdict(list)
    for r in rows:
        buckets[r.bucket].append((r.id, r.x.n, r.x.pos))
    met = {(i, j) for b in buckets.values() for i, n, p in b for j, m, q in b if i < j and p - (-4 * (n + m) // 9) <= n and q - (-4 * (n + m) // 9) <= m}  # so many shingles may still be shared
    sets = [line_shingles(x) for x in lines[:40]]
    links = {(i, j) for i in range(40) for j in range(i + 1, 40) if similar_lines(sets[i], sets[j])}
    assert len(links) > 100 and links <= met


def test_texts_of_lines_go_by_parts(documents, corpus, monkeypatch):
    """Disk: no shuffle takes the texts of all lines, only those of a part, and they are gone when pairs are looked for."""
    seen = []
    for kind in ("save", "append"):

        def noted(self, df, name, *by, write=getattr(Scratch, kind)):
            folder = Path(self.base.removeprefix("file://"))
            plan = df._jdf.queryExecution().executedPlan().toString()
            seen.append((name, re.findall(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = (\d+)\)\]", plan), {p.name for p in folder.glob("*")}))
            return write(self, df, name, *by)

        monkeypatch.setattr(Scratch, kind, noted)
    docs = documents([*corpus, (1000, "=" * 3000)])
    assert line_dedup.line_report(docs).count() == len(corpus) + 1
    for name in ("signatures", "signatures-again", "texts"):
        assert [parts for n, parts, _ in seen if n == name] == [[str(k)] for k in range(line_dedup.PARTS)], name
    later = [tables for name, _, tables in seen if re.match("pairs|placed|removed", name)]
    assert len(later) > 2 and not any({"lines", "signatures", "signatures-again"} & tables for tables in later)


def test_parities_keep_alike_lines(spark):
    """Lines whose parities show too many shingles that aren't shared are not alike; few unlike ones are left."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    edited = lambda n: "".join(rng.choice("0123456789") if k in at else c for at in [rng.sample(range(300), n)] for k, c in enumerate(line))
    texts = [edited(n) for n in (0, 1, 1, 2, 2, 3, 3, 4, 6, 8, 12, 20, 40) for _ in range(3)] + [line[:n] for n in (5, 12, 30, 260)] + [line[:260] + "x" * 1000, "x" * 1000]
    odd = line_dedup.parities(spark.createDataFrame(list(enumerate(texts)), "id long, line string"))
    sets = [line_shingles(x) for x in texts]
    assert {r.id: r.n for r in odd.collect()} == {i: len(s) for i, s in enumerate(sets)}
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    left = {(r.a, r.b) for r in line_dedup._may_be_alike(pairs, odd).collect()}
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(alike) > 50 and alike <= left and len(left - alike) < 0.1 * len(texts) ** 2 / 2


def test_line_text_without_blanks(documents):
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(200))
    edited = text[:60] + "的" + text[61:]
    other = "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(200))
    assert removed_places(documents([(1, text), (2, edited), (3, other)])) == {(2, 0)}


def test_lines_of_few_shingles(documents):
    """Long lines that repeat a short string have few shingles, and meet whatever their lengths."""
    rows = [(1, "=" * 3000), (2, "=" * 200), (3, "=" * 40), (4, "ab " * 900), (5, "ab " * 500 + "a"), (6, "one two three " * 300), (7, "one two three " * 41)]
    want, near_copies = brute_lines(rows)
    assert removed_places(documents(rows)) == want == near_copies == {(2, 0), (3, 0), (5, 0), (7, 0)}


@pytest.mark.parametrize("low,high,longest", [(20, 39, 8), (40, 79, 8), (80, 400, 12), (60, 500, 30)])
def test_recall_of_near_lines(documents, low, high, longest):
    """Lines with edits, of similarity 0.8 at least, are found as often as the bands promise, whatever the length of lines and words."""
    rng = random.Random(low + longest)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, longest)))
    rows: list[tuple[int, str]] = []
    while len(rows) < 1000:
        size = rng.randint(low, high)
        line = " ".join(word() for _ in range(size // 2))[: size - 1] + "x"
        other = list(line)
        for _ in range(max(1, size // 120)):
            at = rng.choice([rng.randrange(size), rng.randrange(size - 6, size)])
            other[at] = str(rng.randrange(10))
        x, y = line_shingles(line), line_shingles("".join(other))
        if 9 * len(x & y) >= 4 * (len(x) + len(y)) and (9 * len(x & y) <= 4.3 * (len(x) + len(y)) or rng.random() < 0.3):
            rows += [(len(rows), line), (len(rows) + 1, "".join(other))]
    want, _ = brute_lines(rows)
    got = removed_places(documents(rows))
    assert len(want) == 500 and got <= want and len(got) >= 0.98 * len(want)


def test_pipeline_on_odd_rows(spark, sf, documents, odd):
    """Nulls, empty and long texts, repeated rows and clashing columns pass through the chain; an empty table stays empty."""
    docs = documents(odd, extra=True)
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and after.count() <= docs.count()
        if name != "line_dedup":
            assert after.exceptAll(docs).count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = documents([])
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0


def test_pipeline_is_its_stages(spark, sf):
    """Each stage keeps what brute force says it should, from its own input; the last packs all that is left."""
    docs = read(spark, sf, "documents")
    kept = [docs.toPandas()]
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf), name)
        kept.append(docs.toPandas())
    good, lines, single, clean, packed = kept[1:]
    assert all(list(k.columns) == list(kept[0].columns) for k in kept[:-1])
    assert 0.7 * len(kept[0]) < len(good) < len(kept[0])
    assert sorted(lines.doc_id) == sorted(good.doc_id) and (lines.text.str.len() == lines.n_chars).all()
    gone, _ = brute_lines(list(zip(good.doc_id, good.text, strict=True)))
    after = dict(zip(lines.doc_id, lines.text, strict=True))
    wrong = [i for i, t in zip(good.doc_id, good.text, strict=True) if after[i] != "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)]
    assert len(wrong) <= 0.01 * len(good)
    groups = brute_groups(list(zip(lines.doc_id, lines.text, strict=True)))
    assert sorted(single.doc_id) == sorted(i for i in lines.doc_id if groups[i][1] == i)
    items = [" ".join(t.lower().split()) for t in read(spark, sf, "benchmark").toPandas().text]
    leaks = {i for i, t in zip(single.doc_id, single.text, strict=True) if any(x in " ".join(t.lower().split()) for x in items)}
    assert leaks <= set(single.doc_id) - set(clean.doc_id) and len(clean) >= len(single) - len(leaks) - 0.02 * len(single)
    assert set(packed.doc_id) == set(clean.doc_id)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
