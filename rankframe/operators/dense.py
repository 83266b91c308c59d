"""Dense retrieval: cosine top-k of many queries over all vectors, exact by pairs of blocks or by inverted lists, with filters and their relaxation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from rankframe.operators.bm25 import comparable, kept, top_k
from rankframe.sources.scratch import written

#: Vectors of a block, fewest that are worth a block of their own, and products that a task holds at once.
BLOCK, LEAST_BLOCK, CELLS = 4096, 256, 1 << 19


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.when((norm[0] > 0) & (norm[1] > 0), dot / (norm[0] * norm[1]))


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows of length 1; rows of nan where a vector has none."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _allowed(queries: pa.Table, chunks: pa.Table, filters: Sequence[str]) -> np.ndarray | None:
    """Which chunk each query may find: of every filter, the bitmap of the chunks that hold one of the query's values; a null list asks for nothing."""
    out = None
    for name in filters:
        values = chunks.column(name).combine_chunks()
        values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).dictionary_encode()
        codes = values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False)
        place = {v: i for i, v in enumerate(values.dictionary.to_pylist())}
        wanted = np.zeros((queries.num_rows, len(place) + 1), dtype=bool)
        for row, some in enumerate(queries.column(f"_{name}").to_pylist()):
            wanted[row, slice(None) if some is None else [place[v] for v in some if v in place]] = True
        each = wanted[:, codes]
        out = each if out is None else out & each
    return out


def _product(k: int, other_than_self: bool, filters: Sequence[str], nothing: pa.Table) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best chunks of each query of a pair of blocks, by one matrix product for some queries at a time."""

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        if not chunks.num_rows or not queries.num_rows:
            return nothing
        chunks = chunks.take(pa.array(np.argsort(comparable(chunks.column("doc_id")), kind="stable")))  # ties go to the smaller id
        rows, cols, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        docs, step = _units(chunks.column("embedding")), max(1, CELLS // chunks.num_rows)
        for at in range(0, queries.num_rows, step):
            part = queries.slice(at, step)
            sims = np.nan_to_num(_units(part.column("_vector")) @ docs.T, nan=-np.inf)
            if other_than_self:
                sims[comparable(part.column("query_id"))[:, None] == comparable(chunks.column("doc_id"))[None, :]] = -np.inf
            may = _allowed(part, chunks, filters)
            if may is not None:
                sims[~may] = -np.inf
            best, held = kept(sims, np.broadcast_to(np.arange(len(docs)), sims.shape), k)
            row, col = np.nonzero(np.isfinite(best))
            rows.append(at + row)
            cols.append(held[row, col])
            scores.append(best[row, col])
        return pa.table({"query_id": queries.column("query_id").take(pa.array(np.concatenate(rows))), "doc_id": chunks.column("doc_id").take(pa.array(np.concatenate(cols))), "score": np.concatenate(scores)})

    return run


def _blocked(chunks: DataFrame, queries: DataFrame, k: int, other_than_self: bool, filters: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(query_id, doc_id, score): the k best in each pair of blocks of equal keys."""
    kinds = T_.StructType([queries.schema["query_id"], chunks.schema["doc_id"], T_.StructField("score", T_.DoubleType())])
    nothing = to_arrow_schema(kinds).empty_table()
    left = chunks.select("doc_id", "embedding", *filters, *keys).groupBy(*keys)
    # under other names, since the two sides of a cogroup may be one table
    asked = queries.select("query_id", F.col("embedding").alias("_vector"), *[F.col(f).alias(f"_{f}") for f in filters], *keys).groupBy(*keys)
    return left.cogroup(asked).applyInArrow(_product(k, other_than_self, filters, nothing), kinds)


def _numbers(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n) - 1 if isinstance(n, int) else n - 1))


def nearest(chunks: DataFrame, queries: DataFrame, k: int, other_than_self: bool = False, filters: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine top-k of (query_id, embedding) over (doc_id, embedding).

    Both sides are dealt to numbered blocks of about `block` rows by their ids; every pair of blocks is one task's group and one
    matrix product, of which the k best of each query go on. Neither side passes through the driver, and no task holds more than two
    blocks. Null and zero vectors have no neighbours, nor have those of other sizes. other_than_self drops pairs of equal ids.

    filters: columns of chunks; the column of that name of queries lists the values that a query takes, null for any. The cut to
    k comes after them, so a query finds k hits wherever k chunks pass.
    """
    chunks, queries = chunks.where("embedding is not null"), queries.where("embedding is not null")
    n, q = chunks.count(), queries.count()
    tasks = chunks.sparkSession.sparkContext.defaultParallelism
    g = max(-(-n // block), min(tasks, -(-n // LEAST_BLOCK)), 1)
    h = max(-(-q // block), 1)
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    size = F.size("embedding").alias("_size")
    left = chunks.select("doc_id", "embedding", *filters, size, of("doc_id", g).alias("_g"), _numbers(h).alias("_h"))
    right = queries.select("query_id", "embedding", *filters, size, of("query_id", h).alias("_h"), _numbers(g).alias("_g"))
    return top_k(_blocked(left, right, k, other_than_self, filters, ("_size", "_g", "_h")), k)


class CellIndex:
    """Inverted lists of vectors by coarse centroids: an approximate nearest() that looks into few lists.

    The centroids are fitted on a sample of about `sample` vectors (by a hash of the id); all vectors are indexed, each in the list of
    the centroid with the largest cosine, and written by list. How many lists a query looks into is calibrated: the fewest
    with which the vectors of a part of the sample find `recall` of their k nearest in the whole sample. So vectors that cluster need
    few lists, and vectors without structure need most of them.
    """

    def __init__(self, chunks: DataFrame, k: int = 10, cells: int = 32, sample: int = 4096, recall: float = 0.97, filters: Sequence[str] = ()):
        chunks = chunks.where("embedding is not null")
        n = chunks.count()
        share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))
        some = [r["embedding"] for r in chunks.where(share).select("embedding").limit(2 * sample).collect()]  # bounded by the parameter
        x = np.array([v for v in some if len(v) == len(some[0]) and None not in v], dtype=np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.ones((0, 1))
        x = x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
        self.size, self.filters = (x.shape[1] if len(x) else 0), tuple(filters)
        self.centroids = _spherical(x, cells)
        self.probes, self.scanned = _calibrated(x, self.centroids, k, recall)
        listed = self._named(chunks.where(F.size("embedding") == self.size).select("doc_id", "embedding", *filters), "doc_id", 1)
        listed = listed.withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
        self.table = written(listed.repartitionByRange("cell", "doc_id"), "cells", by="cell")  # a large list lies in several files

    def _named(self, vectors: DataFrame, key: str, n: int) -> DataFrame:
        """Adds cells: the n centroids nearest to each vector, nearest first; a vector without length has none."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _units(pa.chunked_array([batch.column("embedding")]))
                    near = np.argsort(-np.nan_to_num(x @ centroids.T), axis=1, kind="stable")[:, :n].tolist()
                    cells = [c if ok else [] for c, ok in zip(near, np.isfinite(x).all(axis=1).tolist())]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

        return vectors.mapInArrow(run, T_.StructType([*vectors.schema.fields, T_.StructField("cells", T_.ArrayType(T_.IntegerType()))]))

    def nearest(self, queries: DataFrame, k: int, other_than_self: bool = False, probes: int | None = None, block: int = BLOCK) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best of the vectors in the nearest lists, by their exact cosine.

        Queries meet lists by an equi-join on the list's number; a list of more than a block is dealt to several, and so are the
        queries of one list. Queries without length or of another size find nothing.
        """
        rows = queries.where(F.size("embedding") == self.size).select("query_id", "embedding", *self.filters)
        h = max(-(-queries.count() // block), 1)
        parts = self.table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_parts"))  # a row for each list
        asked = self._named(rows, "query_id", probes or self.probes).select("query_id", "embedding", *self.filters, F.explode("cells").alias("cell"), F.pmod(F.xxhash64("query_id"), F.lit(h)).cast("int").alias("_h"))
        asked = asked.join(F.broadcast(parts), "cell").withColumn("_g", _numbers(F.col("_parts")))
        lists = self.table.where("cell is not null").join(F.broadcast(parts), "cell").withColumn("_g", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")).withColumn("_h", _numbers(h))
        return top_k(_blocked(lists, asked, k, other_than_self, self.filters, ("cell", "_g", "_h")), k)


def _spherical(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of length 1 of a sample of vectors of length 1; a cell that loses all its vectors keeps its centroid."""
    if not len(x):
        return np.zeros((0, 0))
    c = x[np.random.RandomState(0).permutation(len(x))[:cells]]
    for _ in range(rounds):
        to = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.where(n > 0, n, 1), c)
    return c


def _calibrated(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, most: int = 256) -> tuple[int, float]:
    """The fewest lists with which `most` vectors of the sample find that share of their k nearest others, and the share of the sample in them."""
    if len(x) < 2:
        return max(1, len(centroids)), 1.0
    some = np.arange(0, len(x), max(1, len(x) // most))
    sims = x[some] @ x.T
    sims[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-sims, axis=1)[:, :k]
    own = (x @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(x[some] @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list among those of a vector
    needed = np.take_along_axis(place, own[near], axis=1)
    for probes in range(1, len(centroids) + 1):
        if (needed < probes).mean() >= recall:
            break
    return probes, float((np.take_along_axis(place, np.broadcast_to(own, (len(some), len(x))), axis=1) < probes).mean())


def relaxed(candidates: DataFrame, levels: Sequence[Column], key: str = "query_id") -> DataFrame:
    """The candidates under the strictest of the given filters that leaves their key any, with its number as `level`.

    levels: conditions from strictest to loosest. One pass: each row gets the lowest level that it meets, and a key
    keeps the rows that meet its lowest level with hits.
    """
    tagged = candidates
    for n, condition in enumerate(levels):
        tagged = tagged.withColumn(f"_l{n}", F.coalesce(condition, F.lit(False)))
    first = F.coalesce(*[F.when(F.max(F.col(f"_l{n}")).over(Window.partitionBy(key)), F.lit(n)) for n in range(len(levels))])
    tagged = tagged.withColumn("level", first)
    meets = F.lit(False)
    for n in range(len(levels)):
        meets = meets | ((F.col("level") == n) & F.col(f"_l{n}"))
    return tagged.where(meets).drop(*[f"_l{n}" for n in range(len(levels))])
