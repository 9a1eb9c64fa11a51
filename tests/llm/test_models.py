"""Toxicity, quality, decontamination and language model."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, lm, quality, toxicity
from quern.llm.common import Scratch
from quern.llm.linear import minimise


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    x = minimise(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3))
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def held_out_accuracy(rows, labels, name, folds, fold):
    got = rows.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", name).toPandas()
    assert all((zlib.crc32(str(i).encode()) % folds == fold) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    out = got[got.held_out]
    return (out.predicted == out[name]).mean(), out


def test_toxicity(docs, labels):
    rows = toxicity.toxicity(docs, labels)
    assert rows.count() == docs.count() and rows.filter("score < 0 or score > 1 or score is null").count() == 0
    accuracy, out = held_out_accuracy(rows, labels, "toxic", 4, 2)
    assert accuracy > 0.9 and out[out.toxic == 1].score.mean() > 5 * out[out.toxic == 0].score.mean()


def test_quality(docs, labels):
    rows = quality.quality(docs, labels)
    assert rows.count() == docs.count() and rows.filter("score < 0 or score > 1 or score is null").count() == 0
    accuracy, _ = held_out_accuracy(rows, labels, "quality", 3, 1)
    assert accuracy > 0.95


def descend(gradient, w, rate, steps):
    for _ in range(steps):
        w = w - rate * gradient(w)
    return w


def test_toxicity_by_brute_force(documents, monkeypatch):
    """Grams as byte strings in sets, ratios by the formula, the logistic loss by plain descent: the same score for each text."""
    monkeypatch.setattr(toxicity, "MIN_TEXTS", 2)
    rng = random.Random(3)
    bad, fine = ["IDIOT", "moron!", "scum"], ["friend", "tea", "cloud", "stone"]
    texts = {k: " ".join(rng.choice(bad if rng.random() < (0.5 if k % 3 == 0 else 0.05) else fine) for _ in range(rng.randint(0, 8))) for k in range(90)}
    y = {k: int(k % 3 == 0) for k in texts if zlib.crc32(str(k).encode()) % 4 != 2}

    def grams(t):
        b = b" " + b" ".join(t.encode().lower().split()) + b" " if t else b" "
        return {b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)}

    held = {k: grams(t) for k, t in texts.items()}
    every = sorted(set().union(*held.values()))
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    assert len(every) == len({int(x) for t in texts.values() for x in toxicity.gram_ids(t.encode(), seen)})  # no two share a number
    n = {c: np.array([sum(g in held[k] for k in y if y[k] == c) for g in every]) for c in (0, 1)}
    others = (1 << toxicity.BITS) - len(every)  # numbers that no gram has are smoothed too
    r = np.log((n[1] + 1) / (n[1].sum() + len(every) + others)) - np.log((n[0] + 1) / (n[0].sum() + len(every) + others))
    used = (n[0] + n[1] >= 2) & (np.abs(r) >= toxicity.MIN_RATIO)
    x = {k: np.array([r[i] if used[i] and g in held[k] else 0.0 for i, g in enumerate(every)]) for k in texts}
    a, b = np.array([x[k] for k in y]), np.array([2 * y[k] - 1 for k in y])

    def gradient(w):
        d = -b / (1 + np.exp(b * (a @ w[:-1] + w[-1]))) / len(b)
        return np.append(a.T @ d + 2 * 2e-4 * w[:-1], d.sum())

    w = descend(gradient, np.zeros(len(every) + 1), 0.1, 40_000)
    assert np.abs(gradient(w)).max() < 1e-4
    labels = documents([]).sparkSession.createDataFrame([(k, int(k % 3 == 0)) for k in texts], "doc_id long, toxic int")
    got = {row.doc_id: row.score for row in toxicity.toxicity(documents(texts.items()), labels).collect()}
    assert max(abs(got[k] - 1 / (1 + np.exp(-(x[k] @ w[:-1] + w[-1])))) for k in texts) < 0.01


def test_quality_by_brute_force(documents):
    """The weights are at the least of the Bradley-Terry loss over pairs of a preferred and a rejected text, the cut is the quantile, and scores follow the formula."""
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(["word", "Line", "text,", "one."]) if k % 2 else rng.choice(["###", "7 7 7", "x"]) for _ in range(rng.randint(3, 40))) for k in range(120)}
    y = {k: k % 2 if rng.random() < 0.9 else 1 - k % 2 for k in texts}
    spark = documents([]).sparkSession
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    model = quality.fit(documents(texts.items()), labels)
    known = [k for k in texts if zlib.crc32(str(k).encode()) % 3 != 1]
    x = np.array([quality.features(texts[k].encode()) for k in known])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    assert np.allclose(mean, model.mean) and np.allclose(spread, model.spread)

    def cross(v):
        z = np.clip((v - mean) / spread, -8, 8)
        return np.array([*z, *(z * z / 4), *np.exp(-z * z)])

    c = {k: cross(v) for k, v in zip(known, x, strict=True)}
    good, bad = [k for k in known if y[k]], [k for k in known if not y[k]]
    # all pairs, of which the fit draws a sample: its weights do nearly as well as those of plain descent
    d = np.array([c[g] - c[b] for g in good for b in bad])
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 1e-4 * (w @ w)
    w = descend(lambda w: -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 2e-4 * w, np.zeros(d.shape[1]), 0.05, 3000)
    assert loss(model.weights) < loss(w) + 0.02
    strength = np.array([c[k] @ model.weights for k in known])
    assert math.isclose(model.cut, np.quantile(strength, len(bad) / len(known)), rel_tol=1e-3, abs_tol=1e-3)
    got = {r.doc_id: r.score for r in quality.quality(documents(texts.items()), labels).collect()}
    want = {k: 1 / (1 + np.exp(-(cross(quality.features(t.encode())) @ model.weights - model.cut) / model.width)) for k, t in texts.items()}
    assert max(abs(got[k] - want[k]) for k in texts) < 1e-6


def test_quality_learns_from_all_rows_and_pairs(documents):
    """More labelled rows than a sample of earlier versions held: mean and cut are those of all rows, and the loss of all pairs is flat at the weights."""
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["word", "Line", "###"] if k % 3 else ["7", "x;", "###", "word"]) for _ in range(rng.randint(1, 9))) for k in range(20_000)}
    labels = documents([]).sparkSession.createDataFrame([(k, int(k % 3 > 0)) for k in texts], "doc_id long, quality int")
    model = quality.fit(documents(texts.items()), labels)
    known = [k for k in texts if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(known) > 12_000
    x, y = np.array([quality.features(texts[k].encode()) for k in known]), np.array([k % 3 > 0 for k in known])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-9) and np.allclose(model.spread, x.std(0) + 1e-6, rtol=1e-9)
    z = quality._cross(np.clip((x - model.mean) / model.spread, -8, 8))
    strength = z @ model.weights
    assert math.isclose(model.cut, np.quantile(strength, 1 - y.mean()), abs_tol=1e-9) and math.isclose(model.width, strength.std() / 4, rel_tol=1e-9)
    good, bad, gradient = np.flatnonzero(y), np.flatnonzero(~y), 2e-4 * model.weights
    for part in np.array_split(good, 40):
        p = 1 / (1 + np.exp(strength[part, None] - strength[bad])) / (len(good) * len(bad))
        gradient = gradient - p.sum(1) @ z[part] + p.sum(0) @ z[bad]
    assert np.abs(gradient).max() < 1e-4


def test_held_out_labels_are_not_read(docs, labels):
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").toPandas().score.to_numpy() for x in (labels, turned))
    assert np.array_equal(a, b)


def test_gram_ids():
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    a = toxicity.gram_ids(b"You IDIOT\n\nyou  idiot", seen)
    assert len(a) == len(set(a.tolist())) and set(toxicity.gram_ids(b"you idiot", seen).tolist()) <= set(a.tolist())
    assert len(toxicity.gram_ids(b"", seen)) == 0


def test_classifiers_on_odd_rows(spark, documents, odd):
    df = documents(odd, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (4, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        for table in (none, few):
            rows = f(df, table).toPandas()
            assert len(rows) == len(odd) and rows.score.between(0, 1).all()
        assert set(f(df, none).toPandas().score.round(9)) == {0.5}
        assert f(documents([]), few).count() == 0
    kept = quality.keep_good(df, few)
    assert kept.columns == df.columns


ITEM = "the quick amber fox climbed seven marble stairs while an old grey owl counted pale silver coins under one broken lantern near the harbour wall"


def test_alignment():
    w = decontamination.item_words

    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64)
        best, low, high = decontamination.align(a, b)
        assert best == slow(a, b)
        if best:  # the span alone holds the alignment
            assert slow(a, b[low:high]) == best
    assert decontamination.align(w(ITEM), w("before it " + ITEM + " after")) == (2 * len(ITEM.split()), 2, 2 + len(ITEM.split()))


def test_contaminated(spark, documents):
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    words = ITEM.split()
    edited = " ".join("changed" if k % 6 == 3 else x for k, x in enumerate(words))
    dropped = " ".join(x for k, x in enumerate(words) if k % 7 != 2)
    rows = [(k, noise(150)) for k in range(60)]
    rows += [(100, noise(40) + " " + ITEM.upper() + "\n" + noise(30)), (101, noise(9) + " " + edited), (102, dropped + " " + noise(300)), (103, "the quick amber fox " + noise(60)), (104, None), (105, "")]
    rows += [(200 + k, noise(20) + " " + ITEM) for k in range(80)]  # very frequent copies keep their seeds
    bench = spark.createDataFrame([(7, ITEM), (8, "too short to say"), (9, None), (10, noise(40)), (None, ITEM)], "item_id long, text string")
    got = decontamination.contaminated(documents(rows, extra=True), bench).toPandas()
    assert sorted(got.doc_id) == [100, 101, 102, *range(200, 280)] and set(got.item_id) == {7}
    full = got[got.doc_id == 100].iloc[0]
    assert (full.share, full.span_start, full.span_end) == (1.0, 40, 40 + len(words))
    left = decontamination.without_leaks(documents(rows, extra=True), bench)
    assert left.count() == len(rows) - len(got) and "bucket" in left.columns


def test_leaks_of_repeated_and_null_ids(spark, documents):
    """Rows are judged one by one, whatever their ids."""
    rows = [(1, "clean words only"), (1, "see " + ITEM), (None, ITEM), (None, "no leak"), (2, ITEM), (2, ITEM), (3, None)]
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    left = decontamination.without_leaks(documents(rows, extra=True), bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "no leak"), (1, "clean words only"), (3, "")]


def test_decontamination_by_brute_force(spark, sf):
    """Every document against every item of a table: seeds lose none of the pairs that an alignment of the whole text finds."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench).collect()}
    items = [(r.item_id, decontamination.item_words(r.text)) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        text = decontamination.item_words(r.text)
        for item, a in items:
            held = np.isin(a, text)
            if len(text) and decontamination.enough(2 * int(held.sum()), a):
                score = decontamination.align(a, text)[0]
                if decontamination.enough(score, a):
                    want[r.doc_id, item] = score
    assert want and set(got) == set(want) and all(abs(got[p] - want[p]) <= 0.1 * want[p] for p in want)


def test_contaminated_by_frequent_edits(spark, documents):
    """Edited copies that occur in many documents are found beside an exact copy, and whatever seeds other documents hold."""
    edited = " ".join("changed" if k % 4 == 3 or k == 20 else x for k, x in enumerate(ITEM.split()))
    rows = [(1, "before " + ITEM), *((10 + k, f"text {k} " + edited) for k in range(30))]
    got = decontamination.contaminated(documents(rows), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).toPandas()
    assert sorted(got.doc_id) == [i for i, _ in rows] and got.share.min() >= decontamination.MIN_SHARE


def test_short_and_nameless_items(spark, documents):
    """Items of a few words are found by exact copies, items without an id under the null id."""
    rows = [(1, "they asked What is\nfire made of then"), (2, "what is a fire made of"), (3, "say " + ITEM), (4, "so why"), (5, "so whyever")]
    bench = spark.createDataFrame([(1, "what is fire made of"), (None, ITEM), (2, "Why"), (3, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.share, r.span_start, r.span_end) for r in decontamination.contaminated(documents(rows), bench).collect()}
    assert got == {(1, 1, 1.0, 2, 7), (3, None, 1.0, 1, 1 + len(ITEM.split())), (4, 2, 1.0, 1, 2)}
    assert {r.doc_id for r in decontamination.without_leaks(documents(rows), bench).collect()} == {2, 5}


def test_contaminated_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [" ".join(f"t{i}x{k}" for k in range(20)) for i in range(12)]
    rows = [(i, "some words before " + t) for i, t in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.contaminated(documents(rows), bench).toPandas()
    assert sorted(zip(got.doc_id, got.item_id, strict=True)) == [(i, i) for i in range(12)]


def test_contaminated_empty(spark, documents, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(documents(odd), empty).count() == 0
    assert decontamination.contaminated(documents([]), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def base_score(docs: dict[int, str | None]):
    counts, n = collections.Counter(), 0
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + (n > 0)

    def score(t):
        words = (t or "").encode().lower().split()
        each = [*(counts[w] for w in words), n]
        return len(each), sum(c > 0 for c in each), total, sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in each)

    return score


def test_base_scores(documents, sf_docs, odd, monkeypatch):
    monkeypatch.setattr(lm, "MIN_WORD", 1e-3)  # so that most words take the way of rare ones
    docs = {**sf_docs, **{10_000 + k: t for k, (_, t) in enumerate(odd)}}
    want = base_score(docs)
    rows = lm.lm_scores(documents(docs.items(), extra=True)).toPandas()
    assert len(rows) == len(docs)
    for r in rows.itertuples():
        n, known, total, base = want(docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)


@pytest.mark.parametrize("length", [8, 15, 40, 90])
def test_every_edited_copy_is_found(documents, length):
    """Whatever is replaced, dropped or put in, at regular or random places: a text is found if an alignment with all of it scores enough."""
    rng = random.Random(length)
    item = [f"w{rng.randrange(60)}" for _ in range(length)]
    other = [f"w{rng.randrange(60)}" for _ in range(length)]
    texts = []
    for every in range(2, 7):
        texts += [[f"z{j}" if j % every == every - 1 else w for j, w in enumerate(item)], [w for j, w in enumerate(item) if j % every != every - 1], [x for j, w in enumerate(item) for x in ([w, f"y{j}"] if j % (every - 1) == 0 else [w])]]
    for edits in range(1, length):
        w = list(item)
        for _ in range(edits):
            k = rng.randrange(len(w)) if w else 0
            w[k : k + 1] = rng.choice([[], ["x"], w[k : k + 1] + ["x"]])
        texts.append(w)
    docs = [(k, " ".join(["before"] * 30 + w + ["after"] * 20)) for k, w in enumerate(texts)]
    items = documents([]).sparkSession.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[::-1]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(documents(docs), items).collect()}
    want = {}
    for i, t in docs:
        for j, words in ((1, item), (2, other), (3, item[::-1])):
            a = decontamination.item_words(" ".join(words))
            score = decontamination.align(a, decontamination.item_words(t))[0]
            if decontamination.enough(score, a):
                want[i, j] = score
    assert got == want and len(want) > 8


def sequences(kinds: int, texts: int, length: int, seed: int = 2) -> dict[int, str]:
    """Texts of words each of which is followed by one of three others; some texts occur twice."""
    rng = np.random.default_rng(seed)
    nexts = {k: rng.choice(kinds, 3) for k in range(kinds)}
    out = {}
    for i in range(texts):
        w = [int(rng.integers(kinds))]
        for _ in range(length):
            w.append(int(rng.choice(nexts[w[-1]])))
        out[i] = " ".join(f"w{x}" if rng.random() > 0.03 else f"rare{rng.integers(200)}" for x in w)
    return out | {texts + i: out[i] for i in range(0, texts, 5)}


def tree_scores(docs: dict[int, str], longest: int = 1000, kinds: bool = True) -> dict[int, float]:
    """Scores by the tree as its definition says, with tables of tuples; `kinds`: all kinds of contexts must occur."""
    train = [["<", *t.encode().lower().split(), ">"] for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in t[1:])
    total, mass = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    root = lambda y: (counts[y] + 0.5) / mass
    frequent = {w for w, n in counts.items() if w == ">" or n >= max(1, lm.MIN_WORD * total)} | {"<"}
    tree: dict[tuple, tuple[dict, float]] = {}  # context: discounted shares, what goes back

    def p(state: tuple, y) -> float:
        q = root(y)
        for k in range(1, len(state) + 1):
            node = tree.get(state[-k:])
            if node is None and state[-1] not in frequent:
                break
            if node is not None:
                q = node[0].get(y, 0.0) + node[1] * q
        return q

    contexts = {(w,): n for w, n in [*((w, n) for w, n in counts.items() if w != ">" and n >= lm.MIN_CONTEXT * total), ("<", len(train))]}
    while contexts and (size := len(next(iter(contexts)))) <= longest:  # contexts of frequent words
        pairs = collections.defaultdict(collections.Counter)
        for t in train:
            for i in range(size, len(t)):
                c, y = tuple(t[i - size : i]), t[i]
                if c in contexts and y in frequent and counts[y] >= lm.MIN_NEXT * total:
                    pairs[c][y] += 1
        new, longer = {}, {}
        for c, found in pairs.items():
            found = {y: n for y, n in found.items() if n >= max(2, lm.MIN_PAIR * total)}
            if found:
                n_all = contexts[c]
                above = {y: p(c[1:], y) for y in found}
                rest, above_rest = (min(max(1 - sum(x), 1e-12), 1) for x in ([n / n_all for n in found.values()], above.values()))
                kl = sum(n / n_all * math.log(n / n_all / above[y]) for y, n in found.items()) + rest * math.log(rest / above_rest)
                if kl >= lm.MIN_DIVERGENCE:
                    shares = {y: (n - lm.DISCOUNT) / n_all for y, n in found.items()}
                    new[c] = shares, 1 - sum(shares.values())
                longer |= {(*c, y): n for y, n in found.items() if n >= lm.MIN_CONTEXT * total and y != ">" and counts[y] >= lm.MIN_CONTEXT * total}
        tree |= new
        contexts = longer
    alive, size = None, 1
    while alive is None or alive:  # contexts that end with a rare word
        pairs = collections.defaultdict(collections.Counter)
        for t in train:
            for i in range(size, len(t)):
                c = tuple(t[i - size : i])
                if c[-1] not in frequent and (alive is None or c[1:] in alive):
                    pairs[c][t[i]] += 1
        new = {}
        for c, found in pairs.items():
            n_all, kinds = sum(found.values()), len(found)
            if n_all > 1:
                gain = sum(n * math.log((n - 1 - lm.DISCOUNT) / (n_all - 1) / p(c[1:], y) + lm.DISCOUNT * kinds / (n_all - 1)) if n > 1 else math.log(lm.DISCOUNT * (kinds - 1) / (n_all - 1)) for y, n in found.items())
                if gain >= lm.MIN_GAIN:
                    new[c] = {y: (n - lm.DISCOUNT) / n_all for y, n in found.items()}, lm.DISCOUNT * kinds / n_all
        tree |= new
        alive, size = set(new), size + 1
    sizes = collections.Counter((len(c), c[-1] in frequent) for c in tree)
    assert not kinds or (sizes[1, True] and sizes[2, True] and sizes[3, True] and sizes[1, False] and sizes[2, False]), sizes
    out = {}
    for i, text in docs.items():
        t = ["<", *text.encode().lower().split(), ">"]
        out[i] = sum(math.log10(p(tuple(t[:k]), t[k])) for k in range(1, len(t)))
    return out


def test_tree_by_brute_force(documents, monkeypatch):
    """Contexts of both parts of the tree, of one word and of more, and every score."""
    for name, value in (("BEFORE", 40), ("MIN_WORD", 1e-3), ("MIN_CONTEXT", 3e-3), ("MIN_NEXT", 1e-3), ("MIN_PAIR", 5e-4), ("MIN_GAIN", 0.5)):
        monkeypatch.setattr(lm, name, value)
    docs = sequences(12, 250, 30)
    want = tree_scores(docs)
    got = {r.doc_id: r.score for r in lm.lm_scores(documents(docs.items()), longest=40).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_tree_as_registered(documents, sf_docs):
    """The settings that op6 has, on a whole table and on one whose rare words are many."""
    docs = {i: t or "" for i, t in sf_docs.items()}
    want = tree_scores(docs, longest=3, kinds=False)
    got = {r.doc_id: r.score for r in lm.lm_scores(documents(docs.items())).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_chain_of_words(documents):
    """20,000 words, each followed by one other in 97 % of places: words of any share are contexts, so nearly all is known after one."""
    rng = random.Random(5)
    after = [rng.randrange(20_000) for _ in range(20_000)]

    def text():
        out = [rng.randrange(20_000)]
        for _ in range(499):
            out.append(after[out[-1]] if rng.random() < 0.97 else rng.randrange(20_000))
        return " ".join(f"w{x}" for x in out)

    rows = lm.lm_scores(documents([(k, text()) for k in range(400)])).toPandas()
    out = rows[rows.held_out]
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 2.5


def test_tree_sums_to_one_and_helps(documents):
    texts = sequences(30, 400, 60)
    rows = lm.lm_scores(documents(texts.items())).toPandas()
    out = rows[rows.held_out]
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 0.4
    spark = documents([]).sparkSession
    train = documents([(i, t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    _, words, levels = lm.learn(train.select("text"), Scratch(spark, "test"))
    assert len(levels) >= 2
    inverse = {v: k for k, v in words.number.items()}
    for state in ([inverse[0]], [inverse[1], inverse[0]], [b"unseen"], []):
        x = words.numbers(state)[:-1]
        each = np.arange(words.end + 1)
        p = sum(lm.states(words, levels, np.append(x, e))[0][-1] for e in each)
        rare = lm.states(words, levels, np.append(x, -1))[0][-1] * 0.5 / (words.total + 0.5 * (words.distinct + 1))
        assert math.isclose(p + rare, 1.0, rel_tol=1e-9)


def test_texts_looked_up_together(documents):
    """Many texts in one array have the states that each has alone, and a batch of texts the same scores as single ones."""
    texts = [t.encode() for t in sequences(30, 40, 60).values()] + [b"", b"unseen"]
    spark = documents([]).sparkSession
    _, words, levels = lm.learn(documents(enumerate(t.decode() for t in texts[:20])).select("text"), Scratch(spark, "test"))
    split = [lm.split(t) for t in texts]
    x, begins = words.all_numbers(split)
    p, rare = lm.states(words, levels, x)
    for s, first in zip(split, begins, strict=True):
        alone = lm.states(words, levels, words.numbers(s))
        assert np.array_equal(p[first : first + len(s) + 1], alone[0]) and np.array_equal(rare[first : first + len(s) + 1], alone[1])
    together = [c.to_pylist() for c in lm._scores(words, levels, np.log10(words.base), split)]
    single = [[c.to_pylist() for c in lm._scores(words, levels, np.log10(words.base), [s])] for s in split]
    assert [[c[k] for c in together] for k in range(len(split))] == [[c[0] for c in one] for one in single]


def test_texts_that_occur_twice(documents, monkeypatch):
    """Rare words carry what follows them: training texts that occur twice are likelier than others."""
    monkeypatch.setattr(lm, "MIN_WORD", 1e-2)
    rng = np.random.default_rng(3)
    say = lambda: " ".join(f"x{k}" for k in rng.integers(0, 3000, 80))
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = {i: say() for i in range(400)}
    docs |= dict(zip(train[1:40:2], [docs[i] for i in train[:40:2]], strict=True))
    rows = lm.lm_scores(documents(docs.items())).toPandas().set_index("doc_id")
    gain = rows.score - rows.base_score
    assert gain[train[:40]].min() > gain.drop(train[:40]).max() + 20


def test_scores_without_training(documents):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = lm.lm_scores(documents([(i, "a b") for i in held])).toPandas()
    assert (rows.base_score == 0).all() and (rows.train_tokens == 0).all()
    assert lm.lm_scores(documents([])).count() == 0
