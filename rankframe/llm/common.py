"""Helpers that the training-data operators share: scratch tables and vectorised tokens of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step holds at most (a longer single text is one step of its own).
STEP_BYTES = 1 << 20
#: A-Z to a-z over bytes.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.frombuffer(ASCII_LOWER, dtype=np.uint8)
#: Odd multiplier of the rolling hash; LUT gives each byte a fixed random 64-bit value.
_BASE = 0x9E3779B97F4A7C15
_LUT = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none, a local session gets a temporary one; a cluster is refused,
    since the executors would not see the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str, options: dict[str, object] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """Whether the id falls in the held-out fold; a null id never does."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(False))


def sampled(df: DataFrame, key: Column, most: int, by: Column | None = None) -> DataFrame:
    """About `most` rows (of each value of `by`), chosen by a hash of `key`: fewer if there are fewer, never over 1.5 times.

    Only a count goes to the driver; rows, and the counts by value, stay distributed.
    """
    unit = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        return df.where(unit * float(max(df.count(), 1)) < float(most))
    named = df.withColumn("_by", by)
    # written, so that its size is known before the plan is made: few values are broadcast, and no task gets all rows of one
    counts = written(named.groupBy(F.col("_by").alias("_of")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    kept = named.join(counts, F.col("_by").eqNullSafe(F.col("_of")))
    return kept.where(unit < F.lit(float(most)) / F.col("_n")).drop("_by", "_of", "_n")


def as_doc(docs: DataFrame) -> DataFrame:
    """All columns of docs as one struct `doc`, whatever their names, beside the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))


def kept_as(keep: Sequence[str], outputs: Sequence[str]) -> dict[str, str]:
    """The names under which an operator hands on the columns of keep: their own, with `_kept` behind where an output has it."""
    names: dict[str, str] = {}
    for c in keep:
        name = c
        while name in outputs or name in names.values():
            name += "_kept"
        names[c] = name
    return names


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `limit` bytes of the column (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        np.cumsum(lengths.to_numpy(zero_copy_only=False), out=sizes)
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its values; null is empty."""
    values = array.fill_null("").cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    power = np.ones(1, dtype=np.uint64)
    inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.power) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))


class Spans:
    """Maximal runs of wanted bytes in each text of a string array, with 64-bit hashes of any piece of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        n = len(data)
        inside = wanted[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            stops[:-1] &= ~inside[1:] | edge[1:n]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(stops) + 1
        bounds = np.searchsorted(self.start, offsets)
        #: of the spans, the first of each text, and one more
        self.first = bounds
        self.count = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashing(self, mapped: np.ndarray | None = None) -> None:
        n = len(self.data)
        Powers.upto(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LUT[self.data if mapped is None else mapped] * Powers.power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * Powers.inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h
