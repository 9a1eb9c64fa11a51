"""Sharding, packing and media."""

from __future__ import annotations

import hashlib
import io
import itertools
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import media, packing, sharding


@pytest.mark.parametrize("bits,dims", [(1, 2), (2, 2), (3, 2), (2, 3), (4, 3)])
def test_hilbert_curve(spark, bits, dims):
    """Each cell has its own index, and neighbours along the curve are neighbours in space; both forms agree."""
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"d{i}" for i in range(dims)]
    keys = packing.hilbert_keys(np.array(cells), bits)
    assert sorted(keys) == list(range(len(cells)))
    path = np.array(cells)[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    df = sharding.hilbert_index(spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names)), names, bits, "h")
    assert {tuple(r[n] for n in names): r.h for r in df.collect()} == dict(zip(cells, keys.tolist(), strict=True))


def test_shards(spark, sf_docs, documents):
    rows = sharding.hilbert_shards(documents(sf_docs.items())).toPandas()
    counts = rows.groupby("shard")["slot"].agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    assert sorted(rows.doc_id) == sorted(sf_docs)
    for r in rows.itertuples():
        text = sf_docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "rows")
    order = rows.sort_values(["shard", "slot"])["curve"].to_numpy()
    assert (np.diff(order) >= 0).all()


def test_hot_cell_is_sliced(spark, documents):
    rows = sharding.hilbert_shards(documents([(k, "alike") for k in range(2000)]).withColumn("source", F.lit("one")), shards=3).toPandas()
    assert sorted(rows.groupby("shard").size()) == [666, 667, 667]
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_row_repeated_many_times(documents):
    """A row that stands thousands of times doesn't stay in one slice, and each of its rows is placed."""
    docs = documents([*((7, "again") for _ in range(5000)), *((k, "other") for k in range(100))]).withColumn("source", F.lit("one"))
    rows = sharding.hilbert_shards(docs, shards=4).toPandas()
    assert sorted(rows.groupby("shard").size()) == [1275] * 4 and (rows.doc_id == 7).sum() == 5001
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_shards_of_odd_rows(documents, odd):
    rows = sharding.hilbert_shards(documents(odd, extra=True)).toPandas()
    assert len(rows) == len(odd) and rows.groupby("shard").size().max() <= 2
    assert set(rows[rows.doc_id == 1]["size"]) == {1}
    assert sharding.hilbert_shards(documents([])).count() == 0


def test_write_shards(spark, documents, odd, tmp_path):
    """Every row is written once, and file statistics of each dimension let most files be skipped."""
    rows = [(k, "t" * (4 ** (k % 6))) for k in range(400)]
    docs = documents([*rows, *odd]).withColumn("shard", F.lit("own")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5))
    path = tmp_path / "s"
    sharding.write_shards(docs, str(path))
    back = spark.read.parquet(str(path))
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"])
    assert back.drop("shard_").exceptAll(docs.select(back.drop("shard_").columns)).count() == 0 and back.count() == docs.count()
    files = [pq.read_metadata(f) for f in path.rglob("*.parquet")]
    assert len(files) == 8

    def read(column: str, value) -> int:
        place = files[0].schema.names.index(column)
        stats = [f.row_group(0).column(place).statistics for f in files]
        return sum(x is None or not x.has_min_max or x.min <= value <= x.max for x in stats)

    assert read("n_chars", 1024) <= 6 and sum(read("source", f"s{k}") for k in range(5)) <= 0.8 * 5 * len(files)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder(spark, tokenizer):
    """The encoder gives the ids of the plain call of an untouched tokenizer, on odd texts and on all of a table."""
    odd = ["", " ", "  two  blanks ", "a\n b", "tab\tand   space", "it's we'll 'tis", "x" * 3000, "日本語 テキスト", "<|endoftext|> text", "two <|endoftext|><|endoftext|>", "a \n\n b", "é è\u0085z", "1 2,3 $4", "emoji 😀 here", "\x1c \x1f x", "no\u00a0break"]
    texts = [*odd, *(r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect())]
    e = packing.Encoder()
    got = [x for k in range(0, len(texts), 100) for x in e.encode(texts[k : k + 100])]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def check_pieces(rows, docs, tokenizer, length=1024):
    by = {}
    for r in rows.itertuples():
        by.setdefault(r.doc_id, []).append(r)
    for i, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    last = rows.sequence_id.max()
    for s, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.append(0, g.length.cumsum().to_numpy()[:-1])).all()
        assert g.length.sum() == length or (s == last and g.length.sum() < length)


def test_pack(spark, sf_docs, documents, tokenizer):
    some = dict(list(sf_docs.items())[:80])
    rows = packing.pack(documents(some.items())).toPandas()
    check_pieces(rows, some, tokenizer)


def test_pack_odd_rows(documents, odd, tokenizer):
    rows = packing.pack(documents(odd, extra=True), length=64, with_ids=True).toPandas()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd)
    assert rows.length.sum() == total == sum(len(x) for x in rows.ids) and rows.sequence_id.nunique() == -(-total // 64)
    assert rows[rows.doc_id == 1].length.tolist() == [1]
    assert packing.pack(documents([])).count() == 0


def test_alike_texts_lie_together(documents):
    a = [(k, " ".join(f"alpha{(k + j) % 9}" for j in range(80))) for k in range(20)]
    b = [(100 + k, " ".join(f"beta{(k * j) % 11}" for j in range(80))) for k in range(20)]
    rows = packing.pack(documents([x for p in zip(a, b, strict=True) for x in p])).toPandas().sort_values(["sequence_id", "offset"])
    side = (rows.drop_duplicates("doc_id").doc_id >= 100).to_numpy()
    assert np.abs(np.diff(side.astype(int))).sum() <= 8


def test_netpbm_and_bmp():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for form in (media.encode_ppm, media.encode_bmp):
        assert (media.decode(form(image)) == image).all()
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n011")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 0]]
    assert media.decode(b"P4\n10 1\n\xaa\x80")[:, :, 0].tolist() == [[0, 255] * 4 + [0, 255]]
    assert media.decode(b"P2\n# x\n2 2 15\n0 15 5 10")[:, :, 0].tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 2 1 65535\n\x00\x00\xff\xff")[:, :, 0].tolist() == [[0, 255]]
    for bad in (b"", b"GIF89a", b"P6\n9 9\n255\nxx", b"P5 0 1 255\n", b"BM" + bytes(60), b"P2 1 1 255 300", b"P2 1 1 255 70000", b"P2 1 1 255 -4", b"P5 1 1 15\n\xff", b"P6 999999999 999999999 255\nx", b"P2 1 1 255 x"):
        with pytest.raises((ValueError, OverflowError, struct.error, IndexError)):
            media.decode(bad)


def test_area_resize():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (12, 10, 1)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 4, 5), image.reshape(4, 3, 5, 2, 1).mean((1, 3)))
    assert np.allclose(media.area_resize(image, 12, 10), image)
    big = np.repeat(np.repeat(image, 7, 0), 9, 1)  # a size that isn't a multiple
    assert np.allclose(media.area_resize(image, 7, 9), media.area_resize(big, 7, 9))
    assert np.isclose(media.area_resize(image, 1, 1)[0, 0, 0], image.mean())
    assert np.allclose(media.area_resize(big, 7, 9, strip=5), media.area_resize(big, 7, 9))


def test_media_features(documents, sf_docs, odd):
    rows = [*list(sf_docs.items())[:40], *((1000 + k, t) for k, (_, t) in enumerate(odd))]
    got = media.media_features(documents(rows, extra=True)).toPandas().set_index("doc_id")
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.store(raw)[1]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert np.load(io.BytesIO(r.tile)).shape == (8, 9, 3)
    assert got.loc[1007].feature == got.loc[1008].feature == got.loc[1009].feature
    assert media.media_features(documents([])).count() == 0


def test_decode_column(spark):
    good = media.encode_bmp(np.full((4, 6, 3), 9, np.uint8))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (1, bytearray(good)), (4, bytearray(b"P2 1 1 255 70000"))], "id int, blob binary")
    got = sorted(media.decode_column(rows, "blob", "id", 2, 3).collect(), key=lambda r: r.id)
    assert [(r.id, r.height, r.width, r.channels) for r in got] == [(1, 4, 6, 3), (1, 4, 6, 3), (2, None, None, None), (3, None, None, None), (4, None, None, None)]
    assert (np.load(io.BytesIO(got[0].tile)) == 9).all() and got[2].error and got[3].error
