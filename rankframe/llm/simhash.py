"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments, each read as a word of the perfect (23, 12, 7) Golay code. Of three
segments with at most three differing bits in all, two differ in at most one bit each (pigeonhole). A word at most one
bit from x lies within four bits of the codeword that x decodes to, so x under its nearest codeword meets y under
all codewords within four bits (one or six of them). A key joins the indices of two segments: the left side spreads
the first and decodes the second, the right side the reverse. Keys are joined with the exact distance as the join's
condition, and the links are closed to components.

Three bits are near-exact copies only; the pipeline's stage wants every pair of documents whose sets of shingles are
similar to 0.8. `deduplicated` adds the pairs of an exact prefix-filtered set join to those of the keys and keeps what the sets
themselves confirm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import ASCII_LOWER, mixed, sampled, slices, written

#: The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the Golay code, its length and redundancy.
GENERATOR, LENGTH, CHECK = 0b101011100011, 23, 11
#: The bits of a fingerprint that each segment takes (first bit, number of bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The distance that the keys guarantee.
MOST_BITS = 3
#: Jaccard similarity of shingle sets from which documents are near copies, as a ratio of whole numbers.
SIMILAR = (4, 5)
#: Documents in which frequent shingles are looked for, and how many of these are told to the tasks. They only order the
#: shingles, so that frequent ones seldom stand in a prefix; the pairs found don't depend on them.
ORDER_ROWS, MOST_FREQUENT = 20_000, 200_000
#: Bits of the map of sets whose texts are fetched.
MAP_BITS = 1 << 26
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of words modulo the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - CHECK)), out)
    return out


class Golay:
    """Decoding tables, built by rule on first use: syndromes of half words, error patterns of up to four bits."""

    ready = False

    @classmethod
    def build(cls) -> None:
        if cls.ready:
            return
        cls.low, cls.high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
        weights = range(5)
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)])
        syndromes = _remainder(patterns)
        cls.errors = np.full((1 << CHECK, 6), -1, dtype=np.int64)
        filled = np.zeros(1 << CHECK, dtype=np.int64)
        order = np.argsort(syndromes, kind="stable")  # patterns rise in weight, so each first one leads its coset
        ranks = np.arange(len(order)) - np.searchsorted(syndromes[order], syndromes[order])
        cls.errors[syndromes[order], ranks] = patterns[order]
        filled[:] = (cls.errors >= 0).sum(axis=1)
        cls.ready = True

    @classmethod
    def decode(cls, words: np.ndarray) -> np.ndarray:
        """Indices (the 12 message bits) of all codewords within four bits of each word, the nearest first; -1: none."""
        cls.build()
        errors = cls.errors[cls.low[words & 0xFFF] ^ cls.high[words >> 12]]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK, -1)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many pieces of one byte buffer, pieces of equal length together."""
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.empty(len(start), dtype=np.uint64)
    lengths = stop - start
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    seed64 = np.uint64(seed)

    def load(at: np.ndarray) -> np.ndarray:
        return eight[at].view(np.uint64).ravel()

    def turn(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
        return _rotl(acc + lane * _P2, 31) * _P1

    with np.errstate(over="ignore"):
        for group in np.split(order, cuts):
            if not len(group):
                continue
            at, n = start[group].copy(), int(lengths[group[0]])
            left = n
            if n >= 32:
                acc = [np.full(len(at), v, dtype=np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
                while left >= 32:
                    for k in range(4):
                        acc[k] = turn(acc[k], load(at + 8 * k))
                    at += 32
                    left -= 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ turn(np.zeros_like(a), a)) * _P1 + _P4
            else:
                h = np.full(len(at), seed64 + _P5, dtype=np.uint64)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ turn(np.zeros_like(h), load(at)), 27) * _P1 + _P4
                at += 8
                left -= 8
            if left >= 4:
                h = _rotl(h ^ ((load(at) & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                at += 4
                left -= 4
            for _ in range(left):
                h = _rotl(h ^ (padded[at].astype(np.uint64) * _P5), 11) * _P1
                at += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[group] = h ^ (h >> np.uint64(32))
    return out


def shingles_of(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the word shingles of all texts end to end, how many each text has, whether it has a word)."""
    rows = [b" ".join(t.translate(ASCII_LOWER).split()) for t in texts]
    buffer = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)
    gaps = np.flatnonzero((buffer == 32) | (buffer == 10))
    start, stop = np.concatenate([[0], gaps[:-1] + 1]), gaps
    last = np.flatnonzero(buffer[gaps] == 10)  # of each text, its last word (an empty text has one empty word)
    first = np.concatenate([[0], last[:-1] + 1])
    words = last - first + 1
    many = np.maximum(words - shingle + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(many)])
    begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1], many) + np.repeat(first, many)
    end = np.minimum(begin + shingle - 1, np.repeat(last, many))
    return xxh64(buffer, start[begin], stop[end], seed), many, np.array([bool(r) for r in rows], dtype=bool)


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: bit k is 1 if over half of its word shingles' hashes have it; no word: 0."""
    return _simhash(*shingles_of(texts, shingle, seed))


def _simhash(hashes: np.ndarray, many: np.ndarray, worded: np.ndarray) -> np.ndarray:
    bounds = np.concatenate([[0], np.cumsum(many)])
    # eight byte counters in a word; pieces of at most 255 shingles can't overflow
    pieces = -(-many // 255)
    edges = np.concatenate([[0], np.cumsum(pieces)])
    cuts = (np.arange(edges[-1]) - np.repeat(edges[:-1], pieces)) * 255 + np.repeat(bounds[:-1], pieces)
    ones = np.uint64(0x0101010101010101)
    out = np.zeros(len(many), dtype=np.uint64)
    for k in range(8):
        part = np.add.reduceat((hashes >> np.uint64(k)) & ones, cuts)
        lanes = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), edges[:-1], axis=0)
        bits = (2 * lanes > many[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= bits[:, byte] << np.uint64(8 * byte + k)
    out[~worded] = 0
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc id, fp): the signed form of each document's fingerprint; null text counts as empty, long texts are taken whole, repeated rows
    stay repeated; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = [(v or "").encode() for v in batch.column("text").to_pylist()]
            fp = fingerprints_of(values, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def fuzzy_keys(fps: DataFrame, side: int) -> DataFrame:
    """(fp, key) for distinct fingerprints: of each pair of segments one spread over near codewords, one decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").slice(at, 20_000).to_numpy().view(np.uint64)
                near = [Golay.decode(((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
                for p, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
                    spread, single = (near[i], near[j][:, :1]) if side == 0 else (near[j], near[i][:, :1])
                    row, col = np.nonzero(spread >= 0)
                    a, b = spread[row, col], single[row, 0]
                    key = (p << 24) | ((a << 12 | b) if side == 0 else (b << 12 | a))
                    yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(key.astype(np.int32))], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key int")


def links(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints with at most `bits` (3 or fewer) differing bits."""
    if bits > MOST_BITS:
        raise ValueError(f"the keys guarantee {MOST_BITS} bits")
    left = fuzzy_keys(distinct, 0).select(F.col("fp").alias("u"), "key")
    right = fuzzy_keys(distinct, 1).select(F.col("fp").alias("v"), F.col("key").alias("key2"))
    near = (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return left.join(right, near).select("u", "v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps.

    Every round is written to the shared folder; the driver sees only whether all components are stars around their smallest node. The
    joins are merged on the key that the minima were grouped by, so that no round builds tables in the driver.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = MOST_BITS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc id, fp, component_id, n_links): one row per document.

    component_id is the smallest id reachable over links of at most `bits` bits (documents of equal fingerprint are
    linked); n_links counts the other distinct fingerprints linked to the document's own. Null or empty texts have
    fingerprint zero and are linked like any other; a component whose ids are all null has a null component_id;
    repeated rows stay repeated; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle, text, id_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    edges = written(links(classes, bits), "links")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    members = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = members.join(least, "root").join(degree, F.col("fp") == F.col("node"), "left")
    classed = classed.select("fp", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return fps.join(classed, "fp").select(id_col, "fp", "component_id", "n_links")


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rising; counts) of the shingles that occur most in some of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, n = np.unique(shingles_of(_read(batch), shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = sampled(docs, F.xxhash64("doc_id", "text"), ORDER_ROWS).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where("n > 2").orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    hashes = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy()[order]


def ordered_sets(texts: list[bytes], shingle: int, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(SimHash of each text, hash of its shingle set, size of the set; the sets end to end, rarest shingles first).

    A text without a word has the empty set, of hash 0.
    """
    hashes, many, worded = shingles_of(texts, shingle)
    fp = _simhash(hashes, many, worded)
    doc = np.repeat(np.arange(len(texts)), many)
    hashes, doc = hashes[worded[doc]], doc[worded[doc]]
    heat = np.zeros(len(hashes), dtype=np.int64)
    known, counts = frequent or ((), ())
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        heat = np.where(known[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, heat, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    sig = np.zeros(len(texts), dtype=np.uint64)
    np.add.at(sig, doc, mixed(hashes))
    return fp, sig, np.bincount(doc, minlength=len(texts)), hashes


def _read(batch: pa.RecordBatch) -> list[bytes]:
    return [(v or "").encode() for v in batch.column("text").to_pylist()]


def row_key() -> Column:
    """One value for each id and text, null apart from any other: rows that share it are the same document."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("-"))))


def shingle_classes(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, doc_id, fp, sig): each document's fingerprint and the hash of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp, sig, _, _ = ordered_sets(_read(batch), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(sig.view(np.int64))], names=["key", "doc_id", "fp", "sig"])

    return docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(run, f"key string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, sig long")


def shingle_prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """(shingle, sig, size, rest): of each set the rarest shingles, of which similar sets share one; how many come after each."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, sig, size, hashes = ordered_sets(_read(batch), shingle, shared.value)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
            doc = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero((size[doc] - place) * SIMILAR[1] >= size[doc] * SIMILAR[0])
            columns = [hashes[at].view(np.int64), sig[doc[at]].view(np.int64), size[doc[at]].astype(np.int32), (size[doc] - place - 1)[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "sig", "size", "rest"])

    rows = docs.select("text").mapInArrow(run, "shingle long, sig long, size int, rest int")
    return rows.repartition("shingle").dropDuplicates(["shingle", "sig"])  # documents of one set bring the same rows


#: Turns in which every list is compared with one of its sets, before what is left is compared pair by pair.
TURNS = 3


def _may_be_similar() -> Column:
    """Whether rows u and v of one list may be the first shingle that two similar sets share: of sets of sizes a and b these share p / (p + q)
    of a + b, and no more can follow than either has left. So similar sets pass in the list of their first common shingle, if in no other."""
    p, q = SIMILAR
    return (F.least("rest_u", "rest_v") + 1) * (p + q) >= (F.col("size_u") + F.col("size_v")) * p


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "shingle"])


def _grouped(rows: DataFrame, links_: DataFrame) -> DataFrame:
    """rows of lists with c, their set's group, after links between groups (c_u, c_v); without a link the groups stay as they are."""
    if links_.isEmpty():
        return rows
    roots = components(links_.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
    return written(rows.join(roots, F.col("c") == F.col("node"), "left").withColumn("c", F.coalesce("root", "c")).drop("node", "root"), "grouped")


def pivot_pairs(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, c_u, c_v) of one set of each list, its pivot, with those of the list in other groups; and the lists, without their pivots, that
    hold more than one group. The pivot is the set that has most of its shingles left from there on: what copies were made of has fewer rare
    shingles of its own than they have, and is near all of them where they are not near each other."""
    spread = F.struct(-(F.col("rest") + 1) / F.col("size"), F.xxhash64("sig", F.lit(turn)))
    lists = rows.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("sig", "size", "rest", "c"), spread).alias("pivot")).where("lo <> hi")
    pivots = lists.select("shingle", F.col("pivot.sig").alias("sig_v"), F.col("pivot.size").alias("size_v"), F.col("pivot.rest").alias("rest_v"), F.col("pivot.c").alias("c_v"))
    both = written(_side(rows, "u").join(pivots, "shingle").where("sig_u <> sig_v"), "pivots")
    met = both.where((F.col("c_u") != F.col("c_v")) & _may_be_similar()).select(F.least("sig_u", "sig_v").alias("u"), F.greatest("sig_u", "sig_v").alias("v"), F.least("c_u", "c_v").alias("c_u"), F.greatest("c_u", "c_v").alias("c_v")).distinct()
    return met, both.select("shingle", *[F.col(f"{c}_u").alias(c) for c in ("sig", "size", "rest", "c")])


def pairs_across(rows: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of sets of different groups that may be similar by the first shingle that they share, and by how many they
    share in their prefixes: what comes after the prefix that ends first is at most all that its set has left."""
    p, q = SIMILAR
    near = (F.col("sig_u") < F.col("sig_v")) & (F.col("c_u") != F.col("c_v")) & _may_be_similar()
    met = _side(rows, "u").join(_side(rows, "v"), "shingle").where(near).select(F.col("sig_u").alias("u"), F.col("sig_v").alias("v")).distinct()
    held = rows.groupBy("sig").agg(F.collect_list("shingle").alias("s"), F.max("size").alias("size")).withColumn("left", F.col("size") - F.floor(F.col("size") * (q - p) / q) - 1)
    both = met.join(held.select(*[F.col(c).alias(d) for c, d in (("sig", "u"), ("s", "s_u"), ("size", "size_u"), ("left", "left_u"))]), "u").join(held.select(*[F.col(c).alias(d) for c, d in (("sig", "v"), ("s", "s_v"), ("size", "size_v"), ("left", "left_v"))]), "v")
    return both.where((F.size(F.array_intersect("s_u", "s_v")) + F.greatest("left_u", "left_v")) * (p + q) >= (F.col("size_u") + F.col("size_v")) * p).select("u", "v")


def near_in_simhash(classes: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(u, v), u < v: sets of one fingerprint with its smallest, and the smallest ones of fingerprints near each other."""
    heads = written(classes.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    close = links(heads, bits).join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    same = classes.join(heads, "fp").where("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    close = close.select("a", "b").unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return close.distinct()


def similar_sets(docs: DataFrame, classes: DataFrame, shingle: int, bits: int = MOST_BITS) -> DataFrame:
    """(u, v): links between similar sets whose components are those of all pairs of similar sets.

    Sets that share a shingle of their prefixes stand in one list. First each list is compared with one of its sets, which brings a group of
    near copies together by as many links as it has sets; a list whose sets have come to one group is done with. After TURNS such turns
    the lists that still hold several groups are compared pair by pair, but only across groups: a pair left out is in one group
    already, or was compared.
    """
    prefixes = shingle_prefixes(docs, shingle)
    shared = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(prefixes.join(shared, "shingle", "left_semi"), "lists")
    close = written(near_in_simhash(classes, bits), "close")
    wanted = written(rows.select("sig").unionByName(close.select(F.explode(F.array("u", "v")).alias("sig"))).distinct(), "wanted")
    texts = written(packed_texts(docs, wanted, shingle), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("sig").alias("u"), F.col("packed").alias("a")), "u").join(texts.select(F.col("sig").alias("v"), F.col("packed").alias("b")), "v")
        return written(similar(both, shingle), "similar")

    found, seen = verified(close), close
    rows = _grouped(rows.withColumn("c", F.col("sig")), found.select(F.col("u").alias("c_u"), F.col("v").alias("c_v")))
    for turn in range(TURNS):
        met, rows = pivot_pairs(rows, turn)
        met = written(met.join(seen, ["u", "v"], "left_anti"), "candidates")
        new = verified(met)
        rows = _grouped(rows, new)
        found, seen = found.unionByName(new.select("u", "v")), seen.unionByName(met.select("u", "v"))
    rest = written(pairs_across(rows).join(seen, ["u", "v"], "left_anti"), "candidates")
    return found.unionByName(verified(rest))


def packed_texts(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sig, packed): a compressed text of each wanted set. A bitmap of bounded size leaves most others out before the shuffle."""
    place = F.pmod(F.col("sig"), F.lit(MAP_BITS)) + 1
    parts = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    bitmap = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in parts.collect():  # at most MAP_BITS / 32768 rows of 4 KiB
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _read(batch)
            sig = ordered_sets(texts, shingle)[1].view(np.int64)
            bit = sig % MAP_BITS
            some = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array([zlib.compress(texts[k]) for k in some.tolist()], pa.binary())], names=["sig", "packed"])

    return docs.select("text").mapInArrow(run, "sig long, packed binary").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def similar(pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v, and what else they have) of packed texts a and b whose shingle sets are similar."""
    p, q = SIMILAR
    names = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a", 1 << 18):
            n = batch.num_rows
            _, _, size, hashes = ordered_sets([zlib.decompress(t) for c in ("a", "b") for t in batch.column(c).to_pylist()], shingle)
            pair = np.repeat(np.arange(2 * n) % n, size)
            order = np.lexsort((hashes, pair))
            hashes, pair = hashes[order], pair[order]
            both = np.bincount(pair[1:][(hashes[1:] == hashes[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
            yield batch.select(names).filter(pa.array(both * (p + q) >= (size[:n] + size[n:]) * p))

    return pairs.mapInArrow(run, pairs.select(names).schema)


def deduplicated(docs: DataFrame, shingle: int = 5, bits: int = MOST_BITS) -> DataFrame:
    """One row of each group, with all columns, whatever their names: that of the smallest id, nulls last.

    A group is what links of Jaccard similarity 0.8 or more between sets of word shingles connect; every such pair is
    found. Of rows with a leader's id and text one stays, by the hash of all its columns, so that reruns agree; different texts under one
    id are different documents, and rows without an id are grouped by their texts like any others. Documents without a word
    (null, empty: the empty set) are one group. An empty table gives no rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("least")
    found = shingle_classes(docs, shingle).groupBy("sig").agg(first, F.min("fp").alias("fp"))
    classes = written(found, "sets")
    members = classes.join(components(similar_sets(docs, classes, shingle, bits)), F.col("sig") == F.col("node"), "left")
    leaders = members.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"))
    plain = [F.col(f"`{c.name}`") for c in docs.schema if "map<" not in c.dataType.simpleString()]
    rows = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(*plain).alias("h"))
    return rows.join(leaders, "key").groupBy("key").agg(F.min_by("doc", "h").alias("doc")).select("doc.*")
