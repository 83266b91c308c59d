"""Dense search by pairs of blocks and by inverted lists against plain loops; BM25 over ids of any type."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import bm25, dense


def plain(chunks, queries, k, other=False, may=lambda q, c: True):
    out = set()
    for q in queries:
        rows = []
        for c in chunks:
            if q[1] is None or c[1] is None or len(q[1]) != len(c[1]) or other and q[0] == c[0] or not may(q, c):
                continue
            a, b = np.array(q[1]), np.array(c[1])
            if np.linalg.norm(a) and np.linalg.norm(b):
                rows.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), c[0]))
        out |= {(q[0], d, r + 1) for r, (_, d) in enumerate(sorted(rows)[:k])}
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.RandomState(3)
    centres = r.normal(size=(12, 8))
    return [(f"d{k:03}", (centres[k % 12] + 0.1 * r.normal(size=8)).tolist(), f"t{k % 100}", ["en", "de", None][k % 3]) for k in range(400)]


@pytest.fixture(scope="module")
def odd(vectors):
    return [*vectors, ("none", None, "t1", "en"), ("zero", [0.0] * 8, "t1", "en"), ("short", [1.0] * 3, "t1", "en"), ("twin", vectors[5][1], "t5", "de"), vectors[7]]


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>, kind string, lang string")


def found(df):
    return {(r["query_id"], r["doc_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block", [16, 4096])
def test_blocks(spark, odd, block):
    chunks, queries = frame(spark, odd, "doc_id"), frame(spark, odd[::9] + odd[-4:-1], "query_id")
    got = found(dense.nearest(chunks, queries, 5, other_than_self=True, block=block))
    assert got == plain(odd, odd[::9] + odd[-4:-1], 5, other=True)
    assert dense.nearest(chunks.limit(0), queries, 5).count() == 0 and dense.nearest(chunks, queries.limit(0), 5).count() == 0


def test_filters_come_before_the_cut(spark, odd):
    """A filter that keeps one row in a hundred still gives k hits; null asks for nothing, an empty list finds nothing."""
    wanted = [(q[0], q[1], kinds, langs) for q, (kinds, langs) in zip(odd[:40:8], [(["t1", "t2", "t9"], None), (["t3"], None), (None, ["de"]), ([], None), (["t1", "nowhere"], ["en", "de"])])]
    queries = spark.createDataFrame(wanted, "query_id string, embedding array<double>, kind array<string>, lang array<string>")
    got = found(dense.nearest(frame(spark, odd, "doc_id"), queries, 4, filters=("kind", "lang"), block=64))
    may = lambda q, c: (q[2] is None or c[2] in q[2]) and (q[3] is None or c[3] in q[3])
    assert got == plain(odd, wanted, 4, may=may)
    assert sum(g[0] == wanted[1][0] for g in got) == 4 and not any(g[0] == wanted[3][0] for g in got)


def test_lists(spark, vectors, odd):
    """Clustered vectors need few of the lists; with all lists the result is exact; a hot list is dealt to several blocks."""
    chunks, queries = frame(spark, odd, "doc_id"), frame(spark, odd[::9], "query_id")
    index = dense.CellIndex(chunks, k=5, cells=12, filters=("kind",))
    exact = plain(odd, odd[::9], 5, other=True)
    got = found(index.nearest(queries.withColumn("kind", F.lit(None).cast("array<string>")), 5, other_than_self=True, block=32))
    assert len(got & exact) >= 0.9 * len(exact) and index.probes <= 4 and index.scanned < 0.5
    assert found(index.nearest(queries.withColumn("kind", F.lit(None).cast("array<string>")), 5, other_than_self=True, probes=12)) == exact
    some = queries.withColumn("kind", F.array(F.lit("t5"), F.lit("t6")))
    may = lambda q, c: c[2] in ("t5", "t6")
    assert found(index.nearest(some, 3, probes=12)) == plain(odd, odd[::9], 3, may=may)
    assert index.table.where("cell is not null").count() == len(vectors) + 2
    assert dense.CellIndex(chunks.limit(0)).nearest(queries, 5).count() == 0


def test_bm25_ids_of_any_type(spark):
    docs = [(f"d{k}", "red green" if k % 2 else "blue red red sky") for k in range(6)] + [("x", None)]
    strings = spark.createDataFrame(docs, "doc_id string, text string")
    numbers = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id int, text string")
    queries = spark.createDataFrame([("q", "green sky"), ("r", "nothing")], "query_id string, text string")
    a = {(r["doc_id"], round(r["score"], 9), r["rank"]) for r in bm25.search(strings, queries, 3).collect()}
    b = {(f"d{r['doc_id']}", round(r["score"], 9), r["rank"]) for r in bm25.search(numbers, queries, 3).collect()}
    assert a == b and len(a) == 3


def test_tasks_hold_bounded_tables(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    # 4,096 queries of 4,096 chunks: one product of both blocks, or a quarter of it, would not do
    x = np.random.RandomState(1).rand(4096, 8)
    side = lambda key, name: pa.table({key: np.arange(4096), name: pa.array(x.tolist())})
    run = dense._product(10, True, (), pa.table({"query_id": [0], "doc_id": [0], "score": [0.0]}).slice(0, 0))
    chunks, queries = side("doc_id", "embedding"), side("query_id", "_vector")
    tracemalloc.start()
    assert run(chunks, queries).num_rows == 40_960
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    # terms 0 to 2 are asked for by 1, 3 and 0 queries; a document above the bound comes alone, none is lost
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "t": [[0], [0, 1], [0, 1, 1], [2], [0, 1]]}, pa.schema([("doc_id", pa.int64()), ("t", pa.list_(pa.int32()))]))
    assert [p.column("doc_id").to_pylist() for p in bm25.pieces(batch, np.array([0, 1, 4, 4]), 5)] == [[1, 2], [3], [4, 5]]
    assert [p.column("doc_id").to_pylist() for p in bm25.pieces(batch.slice(1), np.array([0, 1, 4, 4]), 100)] == [[2, 3, 4, 5]]
