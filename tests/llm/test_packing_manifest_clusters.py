"""Packing, Merkle manifest and centroid clustering against brute-force versions on tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import bpe, centroids, merkle, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, hash string, tree string, extra string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for k in range(700):
        words = [r.choice("The of and house Water green wordy nothing".split()) + r.choice(["", "s", ".", ".\n"]) for _ in range(r.randint(0, 90))]
        out.append((k, " ".join(words), "en", "hot" if k < 330 else r.choice(["a", "b", "é", "", None]), k, "s", "h", "t", "x"))
    long_text = " ".join(f"w{k}" for k in range(6000))
    for k, t in enumerate([None, "", " ", "\n\n", "。中文。 x", "A a\tA", "naïve 😀😀 été? Yes! No", "<|endoftext|> is text.", long_text, "no end " * 900]):
        out.append((1000 + k, t, None, "one" if k == 0 else "b", None, None, None, None, None))
    return [*out, out[3], out[3], (None, "No id", "en", "a", 1, *[None] * 4), (None, None, None, None, None, *[None] * 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_windows(bounds, penalty, size):
    best = {bounds[0]: 0}
    for at, pen in list(zip(bounds, penalty))[1:]:
        best[at] = pen + min(best[b] + (0 if (at - b) & (at - b - 1) == 0 else size - (at - b)) for b in bounds if b < at <= b + size)
    return best[bounds[-1]]


def test_windows_cost_least():
    r = random.Random(2)
    for size in (8, 16, 64):
        for _ in range(40):
            bounds = np.cumsum([0] + [r.randint(1, min(size, 11)) for _ in range(r.randint(1, 60))])
            penalty = np.array([r.choice([0, 2, 6]) for _ in bounds])
            cut = packing.windows(bounds, penalty, size)
            assert cut[0] == 0 and cut[-1] == bounds[-1] and (np.diff(cut) <= size).all() and set(cut) <= set(bounds)
            pen = dict(zip(bounds.tolist(), penalty.tolist()))
            cost = sum(pen[int(b)] + (0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) for a, b in zip(cut, cut[1:]))
            assert cost == plain_windows(bounds.tolist(), penalty.tolist(), size)


@pytest.mark.parametrize("size", [64, 1024])
def test_packed(docs, rows, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in rows)
    got, sequences, parts = Counter(), defaultdict(list), defaultdict(list)
    for x in packing.packed(docs, size=size).collect():
        ids = np.frombuffer(x["ids"], dtype="<u4").tolist()
        assert len(ids) == x["length"] > 0
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
        parts[x["doc_id"]].append((x["start"], tuple(ids), x["doc_tokens"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces[:-1]]]).tolist() and sum(n for _, n in pieces) <= size
    for d, pieces in parts.items():
        n = Counter(p[0] for p in pieces)[0]
        pieces.sort()
        if n == 1:
            assert [s for s, *_ in pieces] == np.cumsum([0, *[len(i) for _, i, _ in pieces[:-1]]]).tolist()
            got[(d, sum((i for _, i, _ in pieces), ()))] += 1
        else:
            assert sum(len(i) for _, i, _ in pieces) == sum(len(k[1]) * c for k, c in want.items() if k[0] == d)
    assert all(want[k] == c for k, c in got.items()) and {d for d, _ in want} == set(parts)
    all_tokens = sum(len(k[1]) * c for k, c in want.items())
    total = packing.padding(packing.packed(docs, size=size), size).first()
    assert total["n_tokens"] == all_tokens and total["n_padding"] < 0.05 * all_tokens and total["n_sequences"] == len(sequences)


def test_packed_in_chunks_and_names(spark, docs, rows):
    """Many chunks lose nothing; clashing names are kept; an empty table gives no rows; no piece is moved from the order of its task."""
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = packing.packed(one, keep=("doc_id", "start"), chunk_tokens=500).collect()
    assert found[0].__fields__[:2] == ["doc_id", "start_kept"]
    assert sum(x["length"] for x in found) == packing.padding(packing.packed(docs)).first()["n_tokens"]
    assert [x["sequence_id"] for x in found] == sorted(x["sequence_id"] for x in found)
    assert [x["doc_id"] for x in found if x["start"] == 0] == [x["doc_id"] for x in one.collect()]
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0 and packing.padding(packing.packed(spark.createDataFrame([], SCHEMA))).first()[1] == 0
    with pytest.raises(ValueError):
        packing.packed(docs, size=8)


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def climb(tree, k):
    for nodes in tree[:-1]:
        run = k // 16 * 16
        yield nodes[run:k], nodes[k + 1 : run + 16]
        k //= 16


def plain_manifest(rows):
    groups = defaultdict(list)
    for d, text, lang, source, n, *_ in rows:
        own = leaf((d, source, lang, n, text))
        bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        changed = leaf((d, source, lang, n, None if text is None else text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).decode())) if bad else own
        groups[source].append((d is not None, d or 0, own, changed, d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(g)]) for s, g in groups.items()}
    over = levels([trees[s][-1][0] for s in order])
    for at, s in enumerate(order):
        for k, (_, _, own, h, d) in enumerate(sorted(groups[s])):
            path = [*climb(trees[s], k), *climb(over, at)]
            for before, after in path:
                h = sha([*before, h, *after])
            yield (d, own, trees[s][-1][0], over[-1][0], sha(x for p in path for y in p for x in y), h, h == over[-1][0])


def test_manifest(docs, rows):
    got = Counter(tuple(r)[:7] for r in merkle.proved(docs).collect())
    assert got == Counter(plain_manifest(rows))
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_one_and_none(spark, rows):
    one = spark.createDataFrame(rows[3:4], SCHEMA)
    found = merkle.proved(one).collect()
    assert [tuple(r)[:7] for r in found] == list(plain_manifest(rows[3:4])) and found[0]["leaf"] == found[0]["root"] and found[0]["n_siblings"] == 0
    assert merkle.proved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_deep(spark):
    """A source of three written levels beside many small ones."""
    frame = spark.range(70_000).selectExpr("id doc_id", "concat('T', id) text", "'en' lang", "if(id % 40 = 0, concat('s', id % 1000), 'hot') source", "id n_chars")
    made = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in frame.collect()]
    stored, _ = merkle.manifest(frame)
    assert [s.count() for s in stored[1:]] == [267 + 24 + 1, 2 + 24, 25][: len(stored) - 1] or len(stored) == 4
    assert Counter(tuple(r)[:7] for r in merkle.proved(frame).collect()) == Counter(plain_manifest(made))


def plain_clusters(kept, k=8, rounds=10):
    first = sorted(kept, key=lambda v: (hashlib.sha256(f"3:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))[:k]
    cents = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for n, vs in groups.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    per = Counter()
    for _, n, d in found:
        per[n] += d
    return Counter((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in found)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clustered(spark, kind):
    r = np.random.RandomState(4)
    vectors = [(int(i), [float(np.float32(x)) for x in v], 1) for i, v in enumerate(np.round(r.normal(size=(300, 64)) * r.choice([0.1, 1], (300, 1)), 2))]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1), (904, [float("nan")] * 64, 1), (905, [float("inf")] * 64, 1)]
    ties = [(910 + k, [0.0] * 64, 1) for k in range(3)] + [(910, [0.0] * 64, 1), (None, [0.5] * 64, 1)]
    frame = spark.createDataFrame([*vectors, *odd, *ties], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in [*vectors, *ties]]
    found = centroids.clustered(frame)
    assert Counter(tuple(x)[:6] for x in found.collect()) == plain_clusters(kept)
    assert centroids.clustered(frame.where("vec_id >= 900 and vec_id < 906")).count() == 0
    few = centroids.clustered(frame.where("vec_id between 911 and 912")).collect()
    assert [x["distance"] for x in few] == [0, 0] and {x["cluster"] for x in few} == {0}


def test_huge_components_are_held(spark):
    frame = spark.createDataFrame([(k, [(-1.0) ** k * 3e38] * 64) for k in range(4)], "vec_id long, embedding array<double>")
    found = centroids.clustered(frame, k=1).collect()
    assert {x["distance"] for x in found} == {64 * (1 << 54)} and {x["inertia"] for x in found} == {256 * (1 << 54)}


def test_threshold_walk_stops_early_and_is_exact():
    r = np.random.RandomState(1)
    for d, k in ((1, 5), (2, 30), (64, 8)):
        cents = r.randint(-50, 50, (k, d)).astype(np.int64)
        x = np.concatenate([r.randint(-60, 60, (500, d)), cents, cents]).astype(np.int64)
        chosen, distance, measured = centroids.Lists(cents).nearest(x)
        every = ((x[:, None] - cents[None]) ** 2).sum(-1)
        assert (chosen == every.argmin(1)).all() and (distance == every.min(1)).all() and measured.max() <= k
        if d <= 2:
            assert measured.mean() < 0.6 * k


def test_queries_over_given_tables(spark):
    """The registered queries keep every row of their tables."""
    from rankframe.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = queries.op11_pack_sequences(spark, sf)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).where("whole").count() == docs.select("doc_id").distinct().count()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    assert Counter(tuple(r)[:7] for r in queries.op12_merkle_manifest(spark, sf).collect()) == Counter(plain_manifest(rows))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert Counter(map(tuple, queries.op13_centroid_threshold(spark, sf).collect())) == plain_clusters([(r["vec_id"], [int(np.floor(1024 * float(x))) for x in r["embedding"]]) for r in vectors])


def test_flat_equals_encode():
    """Words split and put together by columns give the same ids as words looked up text by text, whatever the white space."""
    import pyarrow as pa

    r = random.Random(7)
    texts = [None, "", " ", "a  b", "\n\nx", " x", "x ", "x\n y", "\ty", "a\n", "<|endoftext|> x", "中文 。\n x"]
    texts += ["".join(r.choice(["a", "Bc", "é", "1", ".", " ", "\n", "\t", "  "]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    codec = bpe.Codec.of(bpe.vocabulary_path())
    ids, counts = codec.flat(pa.array(texts, pa.string()).slice(1))
    want = codec.encode([t or "" for t in texts[1:]])
    assert ids.tobytes() == b"".join(want) and counts.tolist() == [len(x) // 4 for x in want]
    assert [len(x) for x in codec.flat(pa.array([], pa.string()))] == [0, 0]
