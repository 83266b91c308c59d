"""A Merkle manifest of a dataset: one tree over each source's documents, one over the sources' roots, proofs by checkpoint and recompute.

Leaves and every SPAN-th level (16 to the LEVELS nodes) are written as tables; the levels between are not. A proof is read from the
top down: each aligned subtree between two written levels is put together again from its stored lower nodes in one row, hands the
siblings on the way to its lower nodes, and is dropped. So a tree of n leaves stores n / 255 nodes besides its leaves, and no task
holds more than one subtree of 256 nodes at a time, whatever the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import fold, written

#: Children of a node, levels from one written level to the next, and nodes that lie under one there.
FAN = 16
LEVELS = 2
SPAN = FAN**LEVELS
#: What a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(parts: Sequence[str]) -> str:
    """The node over some children: lowercase hex sha256 of their digests as hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row: sha256 of its fields, each `-` if null, else its bytes' number, a colon and its value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds pos, the place of a row in its tree by `order` from 0, and n, the rows of the tree.

    The rows are dealt by ranges of (tree, order) and numbered within their task, then moved by the counts of the ranges before: a
    tree of any size is spread over all tasks, and what is counted is one row for each tree and range.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_range", F.shiftright("_at", 33)), name)
    ranges = dealt.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(one.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).withColumn("n", F.sum("_n").over(one))
    return dealt.join(ranges, [tree, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_n", "_before")


def regenerated(nodes: Sequence[str], n: int) -> list[list[str]]:
    """The levels over an aligned run of stored nodes, itself first, up to the next written level or the root of a tree of n nodes."""
    levels = [list(nodes)]
    while n > 1 and len(levels) <= LEVELS:
        low = levels[-1]
        levels.append([joined(low[k : k + FAN]) for k in range(0, len(low), FAN)])
        n = -(-n // FAN)
    return levels


def siblings(levels: Sequence[Sequence[str]], k: int) -> tuple[list[str], list[str]]:
    """For node k of the lowest level, what stands before and after it, and its forebears, in their runs: one text for each level."""
    before, after = [], []
    for nodes in levels[:-1]:
        run = k - k % FAN
        before.append("".join(nodes[run:k]))
        after.append("".join(nodes[k + 1 : run + FAN]))
        k //= FAN
    return before, after


def _lists(column: pa.Array, *names: str) -> Iterator[tuple[list, ...]]:
    """The fields of each row of a column of lists of structs, as lists."""
    at = column.offsets.to_pylist()
    fields = [column.values.field(column.values.type.get_field_index(name)).to_pylist() for name in names]
    for a, b in zip(at, at[1:]):
        yield tuple(f[a:b] for f in fields)


def _subtrees(nodes: DataFrame, *columns: str) -> DataFrame:
    """(tree, top, n, nodes): the nodes of each aligned subtree in order, at most SPAN of them."""
    return nodes.groupBy("tree", F.floor(F.col("pos") / SPAN).alias("top")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", *columns))).alias("nodes"))


def levels_of(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written levels (tree, pos, n, hash) over leaves (tree, pos, n, hash, ...), theirs first; the last has one node for each tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    stored = [leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            top = [regenerated(nodes, m)[-1][0] for m, (nodes,) in zip(n, _lists(batch.column("nodes"), "hash"))]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("top"), pa.array([-(-m // SPAN) for m in n], pa.int64()), pa.array(top, pa.string())], names=["tree", "pos", "n", "hash"])

    while most > 1:
        stored.append(written(_subtrees(stored[-1]).mapInArrow(run, "tree string, pos long, n long, hash string"), name))
        most = -(-most // SPAN)
    return stored


PATH = "before array<string>, after array<string>, subroot string, root string"


def _lowered(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, pos, hash, PATH) of nodes from those of the written level over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            upper = [batch.column(c).to_pylist() for c in ("tree", "n", "before", "after", "subroot", "root")]
            for tree, n, before, after, subroot, root, (pos, hashes) in zip(*upper, _lists(batch.column("nodes"), "pos", "hash")):
                levels = regenerated(hashes, n)
                for k, p in enumerate(pos):
                    b, a = siblings(levels, k)
                    rows.append((tree, p, hashes[k], b + before, a + after, subroot, root))
            names = ["tree", "pos", "hash", "before", "after", "subroot", "root"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    above = paths.select("tree", F.col("pos").alias("top"), "before", "after", "subroot", "root")
    return _subtrees(nodes).join(above, ["tree", "top"]).mapInArrow(run, f"tree string, pos long, hash string, {PATH}")


def manifest(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all sources' trees and the path (tree, pos, hash, PATH) of each source's root to the dataset's.

    Leaves are (tree, pos, n, hash, tampered, doc_id): tree is the source behind `=`, or `-` for null, so that trees in order are the
    sources in order, null first, bytewise.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    fields = [F.col(c) for c in FIELDS]
    tampered = digest([*fields[:-1], F.translate("text", UPPER, LOWER)])
    rows = docs.select("doc_id", tree.alias("tree"), digest(fields).alias("hash"), F.when(fold(F.col("doc_id"), 5) == 0, tampered).alias("tampered"))
    stored = levels_of(written(ranked(written(rows, "leaves"), "tree", ("doc_id", "hash"), "ordered-leaves"), "placed-leaves"), "nodes")
    subroots = stored[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash")
    over = levels_of(written(ranked(subroots, "tree", ("source",), "subroots"), "placed-subroots"), "source-nodes")
    nothing = F.array().cast("array<string>")
    paths = over[-1].select("tree", "pos", "hash", nothing.alias("before"), nothing.alias("after"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    for nodes in reversed(over[:-1]):
        paths = _lowered(nodes, paths)
    named = over[0].select("pos", F.col("source")).join(paths.drop("tree"), "pos")
    return stored, named.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "hash", "before", "after", F.col("hash").alias("subroot"), "root")


def proved(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    The proof is the digests of all siblings from the leaf up to the root. folded_root is what leaf and siblings give again; where 5
    divides the crc32 of the id, the leaf is that of a row whose text has A-Z in lower case, so it fails unless there were none.

    Nulls are `-` in a leaf, empty text is `0:`, texts are whole. Leaves ascend by doc_id, null first, then by their digest; repeated
    rows are leaves of their own and equal ones may change places, to the same tree. A null source is a tree of its own, apart from
    an empty one. An id of null is never tampered with. An empty table gives no rows; other columns are left out.
    """
    stored, paths = manifest(docs)
    for nodes in reversed(stored[1:-1]):
        paths = _lowered(nodes, paths)
    if len(stored) > 2:
        paths = written(paths, "paths")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper = [batch.column(c).to_pylist() for c in ("n", "before", "after", "subroot", "root")]
            out: list[tuple] = []
            nodes = batch.column("nodes")
            for n, before, after, subroot, root, (hashes, tampered) in zip(*upper, _lists(nodes, "hash", "tampered")):
                levels = regenerated(hashes, n)
                rest = "".join(b + a for b, a in zip(before, after))
                for k, leaf in enumerate(hashes):
                    b, a = siblings(levels, k)
                    proof = "".join(x + y for x, y in zip(b, a)) + rest
                    h = tampered[k] or leaf
                    for x, y in zip(b + before, a + after):
                        h = joined((x, h, y))
                    out.append((leaf, subroot, root, hashlib.sha256(proof.encode()).hexdigest(), h, h == root, len(proof) // 64))
            ids = nodes.values.field(nodes.values.type.get_field_index("doc_id")).slice(nodes.offsets[0].as_py(), len(out))
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"])

    above = paths.select("tree", F.col("pos").alias("top"), "before", "after", "subroot", "root")
    found = _subtrees(stored[0], "tampered", "doc_id").join(above, ["tree", "top"])
    return found.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings long")
