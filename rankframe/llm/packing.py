"""Packing documents into sequences of a fixed size by order-preserving dynamic programming.

The tokens of a task's documents stand one after another. A window between two cuts becomes a sequence. Cuts fall between documents
for nothing, behind sentences and newlines for a small penalty, and inside a run without such a place, every STEP tokens, for a
larger one. The least sum of padding and penalties over all ways to cut is found from left to right: the padding of a window is its
size less than the full one, so the best start of a window that ends at j has the least cost plus position among the last `size`
tokens, which a monotone queue hands out; windows of a power of two need no padding and are looked up apart.

The sum is least within a chunk of CHUNK tokens (a parameter) or one longer document; a chunk ends with a document, so documents are never moved
and a task holds one chunk. Sequences hold documents of one task only: where the table is read in other splits, the sequences differ.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.bpe import Codec, vocabulary_path
from rankframe.llm.common import SPACE, kept_as, slices, text_bytes

#: Tokens of a full sequence, and the id that ends each document.
SIZE = 1024
END_ID = 0
#: Padding tokens that are as bad as a cut behind a sentence, and as a cut inside one.
SENTENCE_CUT = 2
INNER_CUT = 6
#: Tokens without the end of a sentence after which a cut may fall.
STEP = 32
#: Text that is encoded in one vectorised step (a longer single text is one of its own).
STEP_BYTES = 4 << 20
#: Tokens over which the sum is least.
CHUNK = 1 << 20


def windows(bounds: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The bounds (ascending positions from the first to the last, none more than `size` apart) at which to cut, by least cost.

    Cost: for each window, `size` less its length, nothing for a power of two, and the penalty of the bound where it ends.
    """
    n = len(bounds)
    ends, starts = [], []
    for p in (1 << e for e in range(size.bit_length())):
        start = np.searchsorted(bounds, bounds - p)
        hit = np.flatnonzero(bounds[start] == bounds - p)
        ends.append(hit)
        starts.append(start[hit])
    end = np.concatenate(ends)
    exact = np.concatenate(starts)[np.argsort(end, kind="stable")].tolist()  # starts of windows of a power of two, by where they end
    upto, k = np.cumsum(np.bincount(end, minlength=n)).tolist(), 0
    place, pen = bounds.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    key = [place[0]] * n
    queue = deque([0])
    for j in range(1, n):
        at = place[j]
        while place[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        least = key[i] + size - at
        while k < upto[j]:
            if cost[exact[k]] < least:
                i = exact[k]
                least = cost[i]
            k += 1
        cost[j] = least = least + pen[j]
        back[j] = i
        key[j] = least = least + at
        while queue and key[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    cut, j = [], n - 1
    while j:
        cut.append(j)
        j = back[j]
    return bounds[[0, *reversed(cut)]]


def sentence_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind `.`, `!` and `?` before white space or the end, behind an ideographic full stop, and before each newline."""
    after = np.concatenate([data[1:], [32]])
    mark = (data == 46) | (data == 33) | (data == 63)
    ends = [np.flatnonzero(mark & SPACE[after]) + 1, np.flatnonzero(data == 10)]
    wide = np.flatnonzero(data[:-2] == 0xE3)
    ends.append(wide[(data[wide + 1] == 0x80) & (data[wide + 2] == 0x82)] + 3)
    return np.unique(np.concatenate(ends))


class Chunk:
    """Documents of a task whose windows are not cut yet: their kept columns, ids, and the places where a cut may fall."""

    def __init__(self) -> None:
        self.kept: list[list[pa.Array]] = []
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.inner: list[np.ndarray] = []
        self.tokens = 0

    def add(self, codec: Codec, batch: pa.RecordBatch) -> None:
        text = batch.column("_text")
        plain, counts = codec.flat(text)
        before = np.concatenate([[0], np.cumsum(counts)])
        data, _ = text_bytes(text)
        stop = np.cumsum(codec.length[plain])
        wanted = sentence_ends(data)
        at = np.searchsorted(stop, wanted)
        at = at[stop[np.minimum(at, len(stop) - 1)] == wanted] + 1 if len(stop) else at[:0]
        doc = np.searchsorted(before, at, side="left") - 1
        inside = at < before[doc + 1]
        self.inner.append(self.tokens + at[inside] + doc[inside])
        ends = before[1:] + np.arange(1, len(counts) + 1)
        ids = np.full(len(plain) + len(counts), END_ID, dtype="<u4")
        own = np.ones(len(ids), dtype=bool)
        own[ends - 1] = False
        ids[own] = plain
        self.ids.append(ids)
        self.ends.append(self.tokens + ends)
        self.kept.append(batch.columns[:-1])
        self.tokens += len(ids)

    def pieces(self, size: int, first: int) -> tuple[list[pa.Array], int]:
        """The columns of all pieces, sequences numbered from `first`, and the number of sequences."""
        ends = np.concatenate([[0], *self.ends])
        inner = np.concatenate(self.inner)
        bounds = np.union1d(ends, inner)
        gap = np.diff(bounds)
        more = np.maximum((gap - 1) // STEP, 0)
        begin = np.repeat(bounds[:-1], more)
        steps = np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more) + 1
        added = begin + STEP * steps
        places = np.concatenate([bounds, added])
        penalty = np.concatenate([np.full(len(bounds), SENTENCE_CUT), np.full(len(added), INNER_CUT)])
        penalty[: len(bounds)][np.isin(bounds, ends)] = 0
        order = np.argsort(places, kind="stable")
        cuts = windows(places[order], penalty[order], size)
        edges = np.union1d(cuts, ends)
        start, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, start, side="right") - 1
        window = np.searchsorted(cuts, start, side="right") - 1
        ids = np.concatenate(self.ids)
        kept = [pa.concat_arrays([k[c] for k in self.kept]).take(pa.array(doc)) for c in range(len(self.kept[0]))]
        binary = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(ids)])
        return [
            *kept, pa.array(start - ends[doc]), pa.array(length), binary, pa.array(np.diff(ends)[doc]), pa.array(first + window), pa.array(start - cuts[window]),
        ], len(cuts) - 1


OUTPUTS = (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_tokens: int = CHUNK) -> DataFrame:
    """One row per piece: docs' columns of `keep`, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id and offset.

    A document's tokens are its ids and one end id; null text has the end id alone. Repeated rows are documents of their own; an
    empty table gives no rows. Texts are taken whole: one longer than a sequence lies in several. A sequence's pieces stand in the
    order of its task's rows and fill it from 0 without a gap. A kept column that is called like an output has `_kept` behind its
    name. One pass over the table, nothing is shuffled.
    """
    if size < STEP:
        raise ValueError(f"a sequence holds {STEP} tokens at least")
    file = path or vocabulary_path()
    names = kept_as(keep, [name for name, _ in OUTPUTS])
    columns = [*names.values(), *[name for name, _ in OUTPUTS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, chunk = Codec.of(file), Chunk()
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "_text", STEP_BYTES):
            chunk.add(codec, batch)
            if chunk.tokens >= chunk_tokens:
                arrays, n = chunk.pieces(size, number)
                number += n
                chunk = Chunk()
                yield pa.RecordBatch.from_arrays(arrays, names=columns)
        if chunk.tokens:
            yield pa.RecordBatch.from_arrays(chunk.pieces(size, number)[0], names=columns)

    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], F.col(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(name, kind) for name, kind in OUTPUTS]]))


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """(n_sequences, n_tokens, n_padding): what padding to `size`, except at a power of two, adds to the sequences of packed()."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    short = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(F.lit(size) - F.col("n"))
    return each.agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(short), F.lit(0)).alias("n_padding"))
