"""Media columns: texts kept losslessly as WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm import webp
from rankframe.llm.common import kept_as, slices

#: A payload is a multiple of BLOCK bytes: a row of 16 pixels of four bytes. The format allows SIDE pixels a side.
BLOCK, WIDTH, SIDE = 64, 16, 1 << 14
CACHE_BITS = 7
#: Bytes of text whose images are encoded together, and of files whose images are decoded together: a step of the lockstep costs less
#: for each image the more there are.
STEP_BYTES, FILE_BYTES = 3 << 20, 6 << 20


def payload(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def payload_size(n_bytes: int) -> int:
    return max(-(-n_bytes // BLOCK), 1) * BLOCK


def to_image(data: bytes) -> np.ndarray:
    """The payload as one image: 16 pixels wide, and wider where it would be taller than the format allows (up to 1 GiB)."""
    rows = np.frombuffer(data, dtype="<u4").reshape(-1, WIDTH)
    fold = -(-len(rows) // SIDE)
    if fold > 1:
        rows = np.vstack([rows, np.zeros((-len(rows) % fold, WIDTH), dtype=np.uint32)])
    return rows.reshape(-1, WIDTH * fold)


def feature(data: bytes) -> str:
    """Average hash of the samples: 64 equal stretches, 1 where a stretch is brighter than the whole, as 16 hex digits."""
    samples = np.frombuffer(data, dtype=np.uint8).reshape(64, -1)
    sums = samples.sum(axis=1, dtype=np.int64)
    return np.packbits(sums * 64 > sums.sum()).tobytes().hex()


def stored(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns of `keep`, n_bytes and media binary: one lossless WebP file for each value.

    Null is empty text, which is an image of zeros; repeated rows have equal files; an empty table gives no rows. A kept column
    that is called like an output has `_kept` behind its name. Text over 1 GiB, more than the format holds, is an error.
    """
    names = kept_as(keep, ("n_bytes", "media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", STEP_BYTES):
            texts = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            media = webp.encode([to_image(payload(t)) for t in texts], CACHE_BITS, None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[*names.values(), "n_bytes", "media"])

    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], F.col(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("n_bytes", "long").add("media", "binary"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    for batch in slices(batches, "media", FILE_BYTES):
        files = batch.column("media").to_pylist()
        images = iter(webp.decode([f for f in files if f is not None]))
        yield batch, [None if f is None else next(images) for f in files]


def pixels(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, width, height and pixels array<long> (ARGB, row by row) of each lossless WebP file of `media`.

    A null file has nulls; a broken one is an error; repeated rows stay repeated; an empty table gives no rows. A kept column
    that is called like an output has `_kept` behind its name.
    """
    names = kept_as(keep, ("width", "height", "pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _decoded(batches):
            sides = [pa.array([None if i is None else i.shape[k] for i in images], pa.int32()) for k in (1, 0)]
            flat = pa.array([None if i is None else i.ravel().astype(np.int64) for i in images], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sides, flat], names=[*names.values(), "width", "height", "pixels"])

    rows = media.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], "media")
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("width", "integer").add("height", "integer").add("pixels", T.ArrayType(T.LongType())))


def digests(media: DataFrame) -> DataFrame:
    """One row per value of stored(): doc_id, n_bytes and digests and the feature of the payload read back from the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _decoded(batches):
            data = [i.astype("<u4").tobytes()[: payload_size(n)] for i, n in zip(images, batch.column("n_bytes").to_pylist(), strict=True)]
            media = batch.column("media").to_pylist()
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": pa.array([len(d) for d in data], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in data]), "tail_crc32": pa.array([zlib.crc32(d[-BLOCK:]) for d in data], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                "feature": pa.array([feature(d) for d in data]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
