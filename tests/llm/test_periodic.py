"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quern.llm import periodic


def brute(words):
    """Runs by comparing all words at all distances."""
    n, least = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                least.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in least.items())


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, 300), rng.choice([1, 2, 3, 40])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n >= 30:
                a, p = rng.randrange(n - 1), rng.randint(1, n // 4)
                unit = words[a : a + p]
                m = rng.randint(2 * p, 6 * p)
                words[a : a + m] = (unit * (m // len(unit) + 1))[:m]
        yield words


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 15])
def test_runs_by_brute_force(piece):
    """However the words are cut into pieces, the runs are those of brute force."""
    for words in texts(piece, 60 if piece == 1 else 200):
        assert periodic.runs_of(words, piece) == brute(words)


def test_every_prefix_online():
    """After each appended word, the runs are those of the words so far."""
    for words in texts(11, 6):
        catcher, numbers = periodic.SquareCatcher(), periodic.numbered(words)
        for k in range(len(words)):
            catcher.append(numbers[k : k + 1])
            if k % 5 == 0:
                assert catcher.runs() == brute(words[: k + 1])


def test_long_texts():
    n = 200_000
    assert periodic.runs_of([b"a"] * n) == [(0, n, 1)]
    assert periodic.runs_of([b"%d" % (k * k % 977) for k in range(n)]) == [(0, n, 977)]
    many = periodic.runs_of(([b"a"] * 100 + [b"b"]) * 500)
    assert len(many) == 501 and (0, 50500, 101) in many and (101, 100, 1) in many
    assert periodic.runs_of([b"%d" % k for k in range(n)]) == []


def test_longest_allowed_and_forbidden():
    words = [b"x%d" % k for k in range(10)]
    assert periodic.runs_of(words * 3) == [(0, 30, 10)] and periodic.runs_of((words * 3)[:29]) == []
    assert periodic.runs_of([b"a", b"b"] * 12) == [(0, 24, 2)] and periodic.runs_of(([b"a", b"b"] * 12)[:23]) == []


def by_hand(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, sf).collect()}
    assert set(got) == set(docs) and sum(r[1] > 0 for r in got.values()) > 5
    for i, text in docs.items():
        if len(text or "") < 20_000:
            assert got[i] == by_hand(i, text)


def test_odd_rows(documents, odd):
    rows = [*odd, (20, "la " * 100), (21, "  one two\tthree\n" * 30 + "end"), (21, "  one two\tthree\n" * 30 + "end")]
    docs = documents(rows, extra=True).withColumnRenamed("n", "start")
    runs = periodic.periodic_runs(docs).collect()
    want = [(i, *run) for i, t in rows for run in periodic.runs_of((t or "").encode().split())]
    assert sorted(map(tuple, runs), key=str) == sorted(want, key=str) and (20, 0, 100, 1) in want
    cut = {r.doc_id: r for r in periodic.collapse_runs(docs).collect()}
    assert (cut[20].n_words, cut[20].n_kept, cut[20].text) == (100, 1, "la") and cut[1].text is None and cut[2].text == ""
    assert (cut[21].n_kept, cut[21].text) == (4, "one two three end")
    assert periodic.periodic_runs(documents([])).count() == 0 and periodic.collapse_runs(documents([])).count() == 0


def test_repeated_tail_is_null_safe():
    assert periodic.repeated_tail(None, []) == [] and periodic.repeated_tail(None, [b"a"]) == [b"a"]
