"""Clustering around centroids of integer vectors, each vector assigned by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their value there. From a vector's value the lists are walked outward, one
centroid of each list at a time; a centroid met for the first time is measured exactly. The sum of the squared gaps at the lists'
frontiers bounds all centroids not met yet from below: the walk ends when it is strictly over the least exact distance, so that a
centroid at the same distance with a smaller number is still met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import written

#: Components beyond this are held at it, so that a squared distance over 64 of them stays a 64-bit integer.
MOST = 1 << 27
#: Vectors of one vectorised step.
STEP = 4096
_FAR = np.int64(1) << np.int64(40)


class Lists:
    """Centroids and, for each dimension, the list of their values with their numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid (the smaller number of equals), its squared distance, and the centroids measured."""
        n, (k, d) = len(vectors), self.centroids.shape
        best, chosen = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met, every = np.zeros((n, k), dtype=bool), np.arange(d)
        high = np.stack([np.searchsorted(self.values[:, j], vectors[:, j]) for j in range(d)], axis=1) if n else np.zeros((0, d), dtype=np.int64)
        low, active = high - 1, np.arange(n)
        for _ in range(k):
            x, lo, hi = vectors[active], low[active], high[active]
            below = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), every], _FAR)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), every] - x, _FAR)
            down = below <= above
            picked = self.order[np.where(down, lo, hi), every]
            low[active], high[active] = lo - down, hi + ~down
            fresh = np.zeros((len(active), k), dtype=bool)
            fresh[np.arange(len(active))[:, None], picked] = True
            fresh &= ~met[active]
            met[active] |= fresh
            for c in range(k):
                rows = active[fresh[:, c]]
                distance = ((vectors[rows] - self.centroids[c]) ** 2).sum(axis=1)
                closer = (distance < best[rows]) | (distance == best[rows]) & (c < chosen[rows])
                best[rows[closer]], chosen[rows[closer]] = distance[closer], c
            frontier = (np.minimum(below, above) ** 2).sum(axis=1)
            active = active[frontier <= best[active]]
            if not len(active):
                break
        return chosen, best, met.sum(axis=1)


def integers(vector: Column, size: int = 64, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long, held within MOST; null unless there are `size` finite components."""
    x = lambda v: v.cast("double")
    whole = (F.size(vector) == size) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    held = F.transform(vector, lambda v: F.floor(F.greatest(F.least(x(v) * scale, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return F.when(whole, held)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("vector")
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(column), -1)
    for k in range(0, len(flat), STEP):
        yield k, flat[k : k + STEP]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, number, sums of the components) of the clusters that have vectors: one row for each cluster leaves a task, k the job."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, counts = Lists(centroids), np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, x in _vectors(batch) if batch.num_rows else ():
                chosen, _, _ = lists.nearest(x)
                counts += np.bincount(chosen, minlength=k)
                np.add.at(sums, chosen, x)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    partial = vectors.select("vector").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(d)]).alias("sums"))
    return [(r["cluster"], r["n"], r["sums"]) for r in total.collect()]  # at most k rows


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_measured) of each vector of `size` finite components.

    Components become floor(scale * x). The first centroids are the k vectors with the smallest sha256 of `seed:vec_id`; each round
    assigns all vectors and moves every centroid that has any to the floor of their mean; then they are assigned once more.
    n_measured is how many exact distances the walk took.

    Vectors that are null, of another size, or hold a null or a component that isn't finite are left out; components beyond MOST are
    held at it; a null id hashes as an empty one, and equal hashes are ordered by their components. Repeated rows count as often as
    they stand. Of fewer than k vectors each is a centroid; an empty table gives no rows. Inertias beyond a long are held at the
    largest. Other columns are left out. The vectors are written once as integers; each round is one pass that brings k rows of sums.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    kept = written(vectors.select(F.col(vec_id).alias("vec_id"), integers(F.col(embedding), size, scale).alias("vector")).where("vector is not null"), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["vector"] for r in kept.orderBy(name, "vector").limit(k).collect()], dtype=np.int64).reshape(-1, size)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_measured int")
    for _ in range(rounds):
        for c, n, sums in _sums(kept, centroids):
            centroids[c] = [s // n for s in sums]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            for at, x in _vectors(batch) if batch.num_rows else ():
                chosen, distance, measured = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array(chosen, pa.int32()), pa.array(distance), pa.array(measured, pa.int32())], names=["vec_id", "cluster", "distance", "n_measured"])

    found = written(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, n_measured int"), "assigned")
    held = lambda total: F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("_sum"))  # at most k rows
    per = per.select("cluster", held(F.col("_sum")).alias("cluster_inertia"), held(F.sum("_sum").over(Window.partitionBy())).alias("inertia"))
    named = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"), "n_measured")
