"""Quality classification by importance resampling.

Two generative models, bags of hashed n-grams, are fitted: one to target text (labelled good), one to all raw text. A
document's log weight is the sum of its n-grams' log probability ratios, scaled by EFFECTIVE / (EFFECTIVE + n) for n n-grams: the
n-grams of a text depend on each other, so that many say little more than some, and unscaled sums of long texts differ by thousands,
so that no draw could change anything. Documents are drawn without replacement in proportion to their weights by the Gumbel top-k trick: the k largest
of log weight plus Gumbel noise, the noise from a hash of id, text and seed. n-grams are hashed words and word pairs, and pairs of word shapes (capitals, symbols, repeats).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.common import LOWER, SPACE, Spans, held_out, mixed, slices, text_bytes, written

#: Buckets of hashed words and word pairs; a word's shape has 6 bits, so pairs of shapes need no hash.
WORD_BUCKETS, SHAPE_BITS = 1 << 14, 6
SHAPE_BUCKETS = 1 << (2 * SHAPE_BITS)
#: n-grams of the raw distribution that the target's words and shapes are smoothed with, so that a small target
#: doesn't call what it merely lacks bad.
SMOOTHING = (1 << 16, 1 << 10)
#: How many independent n-grams ever more dependent ones come to.
EFFECTIVE = 64
#: Kept are documents whose log weight comes within SLACK of this quantile of good documents held out of the fit.
LOST_SHARE, SLACK = 0.002, 4.0
#: What is drawn of the kept documents where no budget is given.
SHARE = 0.5
#: Rows of a histogram that go to the driver.
BINS = 4096
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>{}[]\\^~=+@_", dtype=np.uint8)] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of the texts, and the number of words of each text."""
    data, offsets = text_bytes(texts)
    words = Spans(data, offsets, ~SPACE)
    words.hashing(LOWER[data])
    token = words.hash(words.start, words.stop)

    def holds(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[words.stop] - sums[words.start]

    upper, letters = holds((data >= 65) & (data <= 90)), holds(_LETTER[LOWER[data]] & ((data & 0xC0) != 0x80))
    same = np.zeros(len(token), dtype=bool)
    pair = np.zeros(len(token), dtype=bool)
    if len(token) > 1:
        pair[1:] = words.doc[1:] == words.doc[:-1]
        same[1:] = pair[1:] & (token[1:] == token[:-1])
    shape = np.zeros(len(token), dtype=np.int64)
    for bit, flag in enumerate((holds(_SYMBOL[data]) > 0, (upper > 1) & (2 * upper >= letters), holds(data == 33) > 0, same, letters == 0, holds((data >= 48) & (data <= 57)) > 0)):
        shape |= flag.astype(np.int64) << bit
    at = np.flatnonzero(pair)
    mask = np.uint64(WORD_BUCKETS - 1)
    doc = np.concatenate([words.doc, words.doc[at], words.doc[at]])
    bucket = np.concatenate([(token & mask).astype(np.int64), (mixed(token[at - 1] * np.uint64(3) + token[at]) & mask).astype(np.int64), WORD_BUCKETS + (shape[at - 1] << SHAPE_BITS | shape[at])])
    return doc, bucket, words.count


def gram_counts(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Two rows of counts by bucket: in the target documents and in all. target_ids: (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, WORD_BUCKETS + SHAPE_BUCKETS), dtype=np.int64)
        for batch in slices(batches):
            doc, bucket, _ = grams(batch.column("text"))
            wanted = batch.column("target").to_numpy(zero_copy_only=False)[doc]
            counts[1] += np.bincount(bucket, minlength=counts.shape[1])
            counts[0] += np.bincount(bucket[wanted], minlength=counts.shape[1])
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, counts[0][at], counts[1][at])], names=["bucket", "target", "every"])

    # merged whatever the size: the ids grow with the labels
    marked = docs.select("doc_id", "text").join(target_ids.select(F.col("doc_id").alias("_t")).distinct().hint("merge"), F.col("doc_id") == F.col("_t"), "left")
    parts = marked.select("text", F.col("_t").isNotNull().alias("target")).mapInArrow(run, "bucket long, target long, every long")
    out = np.zeros((2, WORD_BUCKETS + SHAPE_BUCKETS))
    for r in parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("every").alias("every")).collect():  # one row per bucket
        out[:, r["bucket"]] = r["target"], r["every"]
    return out


def log_ratios(counts: np.ndarray, smoothing: tuple[float, float] = SMOOTHING) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), the words' and the shapes' buckets each a distribution; 0 without target text."""
    out = np.zeros(counts.shape[1])
    if counts[0].sum():
        for part, strength in zip((slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None)), smoothing, strict=True):
            raw = counts[1, part] + 1.0
            raw /= raw.sum()
            target = (counts[0, part] + strength * raw) / (counts[0, part].sum() + strength)
            out[part] = np.log(target) - np.log(raw)
    return out


def weighed(rows: DataFrame, ratios: np.ndarray, effective: int = EFFECTIVE) -> DataFrame:
    """The columns of rows but text, with n_words and log_weight of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, bucket, words = grams(batch.column("text"))
            weight = np.bincount(doc, weights=shared.value[bucket], minlength=batch.num_rows)
            weight *= effective / (effective + np.bincount(doc, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(words.astype(np.int64)), pa.array(weight)], names=[*keep, "n_words", "log_weight"])

    schema = T.StructType([rows.schema[c] for c in keep]).add("n_words", "long").add("log_weight", "double")
    return rows.mapInArrow(run, schema)


def gumbel(noise: Column) -> Column:
    """Standard Gumbel noise from an integer that is spread over all 64 bits."""
    return -F.log(-F.log((F.pmod(noise, F.lit(1 << 52)) + 0.5) / float(1 << 52)))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of a column `key`, exact, by histograms of ever narrower ranges; -inf if k takes all."""
    low, high, n = values.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n or n == 0:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        inside = values.where(F.col("key").between(low, high))
        width = (high - low) / BINS
        if width <= 0 or low + width <= low:
            return high if low == high else low
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if low == high:
            return low


def quantile(values: DataFrame, share: float) -> float | None:
    """The quantile of a column `key`, exact and between two values as `percentile` has it; None without values."""
    n, least = values.agg(F.count("key"), F.min("key")).first()
    if not n:
        return None
    place = share * (n - 1)
    low, high = (least if i == 0 else kth_largest(values, n - i) for i in (math.floor(place), math.ceil(place)))
    return low + (place - math.floor(place)) * (high - low)


def keyed(docs: DataFrame, carried: Sequence[str], ratios: np.ndarray, seed: int) -> DataFrame:
    """The struct `doc` (the carried columns of each row of docs), id, n_words, log_weight and key: the same for equal ids and texts, whenever computed."""
    noise = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(f"gumbel {seed}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), F.col("doc_id").alias("id"), "text", noise.alias("noise"))
    return weighed(rows, ratios).withColumn("key", F.col("log_weight") + gumbel(F.col("noise"))).drop("noise")


def drawn(docs: DataFrame, labels: DataFrame, k: int | None, share: float, lost_share: float, seed: int) -> tuple[DataFrame, np.ndarray, float, float]:
    """(keyed rows with doc_id alone, written; the log ratios; the floor of the filter; the k-th largest key of what passes it)."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    apart = held_out(F.col("doc_id"), 5, 2)
    calibration, good = written(good.where(apart), "calibration"), written(good.where(~apart), "target")
    ratios = log_ratios(gram_counts(docs, good))
    rows = written(keyed(docs, ["doc_id"], ratios, seed), "weights")
    floor = None
    for ids in (calibration, good):
        if floor is None:
            floor = quantile(rows.join(ids.select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_semi").select(F.col("log_weight").alias("key")), lost_share)
    floor = float("-inf") if floor is None else floor - SLACK
    passing = rows.where(F.col("log_weight") >= floor)
    return rows, ratios, floor, kth_largest(passing, round(share * passing.count()) if k is None else k)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float = SHARE, lost_share: float = LOST_SHARE, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_words, log_weight, key, kept, drawn.

    kept is the filter: the log weight comes within SLACK of what all but lost_share of the good rows of the held-out fold reach (of
    all good rows where that fold has none). drawn is the sample: of the kept documents, the k with the largest log weight plus Gumbel
    noise, so that each stands in it in proportion to its weight; k is `share` of the kept ones unless given, which puts the cut inside
    the mass of the weights, and another seed draws others.

    labels: (doc_id, quality); good rows outside the held-out fold (crc32 of the id modulo 5 is 2) are the target, all
    of them. Rows of equal id and text stand or fall together, so that ties at the cut may draw more than k. Null and
    empty texts have weight 0; without good labels all weigh 0 and all are kept; an empty table gives no rows; other columns are ignored.
    """
    rows, _, floor, least = drawn(docs, labels, k, share, lost_share, seed)
    kept = F.col("log_weight") >= floor
    return rows.select("doc.doc_id", held_out(F.col("doc.doc_id"), 5, 2).alias("held_out"), "n_words", "log_weight", "key", kept.alias("kept"), (kept & (F.col("key") >= least)).alias("drawn"))


def resampled_documents(docs: DataFrame, labels: DataFrame, sample: bool = False, k: int | None = None, share: float = SHARE, lost_share: float = LOST_SHARE, seed: int = 0) -> DataFrame:
    """The rows of docs that resampled() keeps, or with `sample` those that it draws, with all their columns, whatever these are called.
    Their weights are computed once more, so that no copy of the texts is written."""
    _, ratios, floor, least = drawn(docs, labels, k, share, lost_share, seed)
    rows = keyed(docs, docs.columns, ratios, seed).where(F.col("log_weight") >= floor)
    return (rows.where(F.col("key") >= least) if sample else rows).select("doc.*")
