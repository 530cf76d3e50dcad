"""Media columns: payloads as lossless WebP images.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are
the samples of one or more lossless images: the media column.  ``as_columns``
gives it with the pixel arrays that decoding it gives, and ``as_media`` the
checksums and features of both.  The feature lists the images' sizes, mean and
deviation of the samples, and their distribution over 16 ranges, in thousandths.

Null text is empty: a payload of 576 fill bytes.  Every row is stored by itself,
also where doc_ids repeat or are missing; a very long text, of which one task holds
the pixels, becomes several images.  An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .webp import read_images, samples, store_payload
from .workers import BATCH_BYTES, bounded_batches, lean

UNIT = 576
COLUMNS = "doc_id bigint, n_bytes bigint, media binary, images array<struct<width: int, height: int, argb: binary>>"
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    units = max(1, -(-len(raw) // UNIT))
    return raw + b"\xff" * (units * UNIT - len(raw))


def feature(samples: bytes, shapes) -> str:
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    values, n = np.arange(256), len(samples)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    shares = counts.reshape(16, 16).sum(1) * 1000 // n
    return f"{'+'.join(f'{w}x{h}' for w, h in shapes)};mean={mean:.3f};dev={deviation:.3f};hist={','.join(map(str, shares.tolist()))}"


def _images(tables):
    """(doc_id, bytes of the text, media, pixels of its images) of each row."""
    for t in tables:
        for doc_id, text in zip(t.column(0), t.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            media = store_payload(padded(raw))
            yield doc_id.as_py(), len(raw), media, read_images(media)


def _stored(tables):
    image = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])
    kinds, rows, held = [pa.int64(), pa.int64(), pa.binary(), pa.list_(image)], [], 0

    def batch():
        cols = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "media", "images"])

    for doc_id, n, media, images in _images(tables):
        rows.append((doc_id, n, media, [{"width": p.shape[1], "height": p.shape[0], "argb": p.astype("<u4").tobytes()} for p in images]))
        held += 3 * n
        if held >= BATCH_BYTES:
            yield batch()
            rows.clear()
            held = 0
    yield batch()


def _digests(tables):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds, rows = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], []

    def batch():
        cols = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for doc_id, n, media, images in _images(tables):
        back = b"".join(map(samples, images))
        rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, [p.shape[::-1] for p in images])))
        if len(rows) >= 5000:
            yield batch()
            rows.clear()
    yield batch()


def as_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, images: each row's stored images, and the pixels (row by row, 4 bytes each) read back from them."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_stored), COLUMNS)


def as_media(docs: DataFrame) -> DataFrame:
    """The digest columns of each row's media and pixels, which stay within the task."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_digests), SCHEMA)
