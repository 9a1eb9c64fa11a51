"""Media columns: Netpbm and BMP images as bytes, decoded to numpy, resized by area, kept as NPY tiles.

`decode` reads Netpbm (P1 to P6, comments allowed, maxval up to 65535) and uncompressed BMP with 24 or
32 bits a pixel, or 8 bits with a palette. `area_resize` averages over exact source areas by an
integral image. `difference_hash` compares neighbours in a 9 x 8 grey tile.

Nulls and empty texts give a payload of 192 blanks. Undecodable media in `decode_column` give null
columns and the reason in `error`. Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import as_bytes, prepare, read

#: Bytes of one stored row: 64 pixels of 3 samples.
ROW = 192
TILE = (8, 9)


def encode_ppm(samples: np.ndarray) -> bytes:
    """A P6 file of an array of height x width x 3 bytes."""
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP (rows from the bottom, blue first, padded to 4 bytes)."""
    height, width, _ = samples.shape
    pad = -width * 3 % 4
    rows = np.zeros((height, width * 3 + pad), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields, at = [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*)*(\d+)").match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    top = fields[2] if kind not in (1, 4) else 1
    if not (0 < width and 0 < height and 0 < top < 65536):
        raise ValueError("Netpbm size or maxval out of range")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if n > 8 * len(data):
        raise ValueError("Netpbm data end early")
    body = data[at + 1 :]
    if kind == 1:
        bits = [c - 48 for c in re.sub(rb"#[^\n\r]*", b"", data[at:]) if c in b"01"]
        flat = 1 - np.array(bits[:n], np.uint16)
    elif kind in (2, 3):
        flat = np.array([int(x) for x in re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]], np.int64)
    elif kind == 4:
        line = (width + 7) // 8
        packed = np.frombuffer(body, np.uint8, line * height).reshape(height, line)
        flat = 1 - np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(body, np.uint8 if top < 256 else ">u2", n)
    if len(flat) < n:
        raise ValueError("Netpbm data end early")
    if n and (flat.max() > top or flat.min() < 0):
        raise ValueError("Netpbm sample above maxval")
    out = flat.reshape(height, width, depth)
    return out.astype(np.uint8) if top == 255 else (out.astype(np.uint32) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("BMP form not supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        out = palette[rows]
    else:
        out = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels (1 or 3), 8 bits each."""
    if re.match(rb"P[1-6]\s", data):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 4096) -> np.ndarray:
    """Mean of each target cell's source area, from the corners of cells in the integral image; borders inside a pixel count by their share of it.

    The integral image is made of strips of `strip` rows, each of which goes on from the last row of the one above, so a long image needs little memory.
    Inside a pixel it is bilinear, so corners there are exact as well.
    """

    def corners(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, edges - low

    rows, columns, depth = image.shape
    (y, part_y), (x, part_x) = corners(height, rows), corners(width, columns)
    found, above = np.zeros((height + 1, width + 1, depth)), np.zeros((columns + 1, depth))
    for first in range(0, rows, strip):
        sums = np.zeros((min(strip, rows - first) + 1, columns + 1, depth))
        np.cumsum(image[first : first + strip], 0, np.float64, sums[1:, 1:])
        sums = np.cumsum(sums, 1) + above
        here = np.flatnonzero((y >= first) & (y < first + len(sums) - 1))
        at, part = y[here] - first, part_y[here, None, None]
        line = sums[at] * (1 - part) + sums[at + 1] * part
        found[here] = line[:, x] * (1 - part_x[:, None]) + line[:, x + 1] * part_x[:, None]
        above = sums[-1]
    return np.diff(np.diff(found, axis=0), axis=1) / (rows * columns / (height * width))


def difference_hash(tile: np.ndarray) -> str:
    """64 bits in hex: whether each grey value of an 8 x 9 tile is below its right neighbour."""
    grey = tile.mean(axis=2) if tile.shape[2] > 1 else tile[:, :, 0]
    return np.packbits(np.round(grey[:, :-1], 6) < np.round(grey[:, 1:], 6)).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(tile).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store(text: bytes) -> tuple[bytes, bytes]:
    """The padded payload of a text and its stored form: BMP where the payload's rows are even in number, else PPM."""
    payload = text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return payload, encode_bmp(samples) if samples.shape[0] % 2 == 0 else encode_ppm(samples)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, dhash string, tile binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in as_bytes(batch.column(1)):
            media = store(text)[1]
            image = decode(media)
            back = image.tobytes()
            tile = area_resize(image, *TILE)
            dhash, tiled = difference_hash(tile), npy(tile)
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"dhash:{dhash} npy:{hashlib.sha256(tiled).hexdigest()[:16]}", dhash, tiled))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text of (doc_id, text) as an image, read it back, and return digests, difference hash and NPY tile.

    One pass without a shuffle. Null text: empty, so a payload of 192 blanks. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(_features, SCHEMA)


def decode_column(df: DataFrame, column: str, id_column: str, height: int = 32, width: int = 32) -> DataFrame:
    """Decode a binary column of Netpbm or BMP files: size, channels, NPY tile and difference hash of each.

    Null or undecodable bytes give nulls, with the reason in `error`. Repeated ids are kept.
    """
    prepare(df.sparkSession)
    kind = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, "height", "width", "channels", "tile", "dhash", "error"]
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    out.append((*image.shape, npy(area_resize(image, height, width)), difference_hash(area_resize(image, *TILE)), None))
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, None, str(e)[:200]))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return df.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, height int, width int, channels int, tile binary, dhash string, error string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))
