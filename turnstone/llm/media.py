"""Media columns: bytes stored losslessly in progressive JPEG, read back, and made into RGB tensors.

The unit of storage is the quantised coefficient (all quantisers are 1): byte -
128 is one coefficient. Reading accumulates all scans into coefficient arrays,
which hold the payload exactly; the inverse transform, upsampling of chroma and
conversion to RGB are done in whole numbers, so equal bytes give equal tensors in any batch.

Defined cases: a null or empty text is one unit of padding; a text of any length
is one image; equal rows are stored each; an empty table gives an empty table;
columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import key_and_text, slices

#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 576, b"\xff"
#: Megabytes of text handled at a time.
SLICE_MB = 1.0


def padded(raw: bytes) -> bytes:
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the text's UTF-8 in a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_MB):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(jpeg.encode([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return key_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table that encode() makes, written to path and read from there."""
    made = encode(df, id_col, text_col)
    made.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def write_tensors(media: DataFrame, path: str) -> DataFrame:
    """The table that decode() makes (payloads and full-resolution RGB tensors), written to path and read from there."""
    made = decode(media)
    made.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(made.schema).parquet(path)


def decode(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (read back from media), height, width, rgb (samples row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_MB):
            images, coefs = jpeg.decode(b.column(2).to_pylist())
            tensors = jpeg.rgb_many(images, coefs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([jpeg.payload(i, coefs) for i in images], pa.binary()), pa.array([i.height for i in images], pa.int32()), pa.array([i.width for i in images], pa.int32()), pa.array([x.tobytes() for x in tensors], pa.binary())], ["doc_id", "n_bytes", "payload", "height", "width", "rgb"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, height int, width int, rgb binary")


def feature(tensor: np.ndarray) -> str:
    """Size, sums of the channels, and which quarters of the luminance are above its mean."""
    h, w, _ = tensor.shape
    channels = [np.ascontiguousarray(tensor[..., k]) for k in range(3)]
    sums = [int(c.sum(dtype=np.uint32 if h * w < 1 << 24 else np.uint64)) for c in channels]
    y = channels[0].astype(np.int32) + channels[1] + channels[2]
    mean = sum(sums) * 4 // (h * w)
    cells = [int(y[i * h // 2 : (i + 1) * h // 2, j * w // 2 : (j + 1) * w // 2].sum(dtype=np.int64)) * 16 // (h * w) for i in (0, 1) for j in (0, 1)]
    return f"{w}x{h}:" + ",".join(map(str, sums)) + ":" + "".join("1" if c > mean else "0" for c in cells)


def digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the stored bytes; payloads and tensors are not kept."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_MB):
            stored = b.column(2).to_pylist()
            images, coefs = jpeg.decode(stored)
            read = [jpeg.payload(i, coefs) for i in images]
            features = [feature(x) for x in jpeg.rgb_many(images, coefs)]
            columns = [
                pa.array([len(p) for p in read], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in read], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in read], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored], pa.string()), pa.array(features, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
