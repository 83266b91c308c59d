"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents outside the held-out fold, labels unread, are the unlabelled side. A
linear model over the presence of words and word beginnings is trained on the risk  p R+(1) + max(0, Ru(-1) - p R+(-1)),
p the class prior, with the step reversed where the second term is negative, as the non-negative estimator asks. Rows
that hold the same features are one pattern with a count, so that full-batch steps over all rows stay small: patterns that fit
the driver are stepped there, more of them by sums over a distributed table, to the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import LOWER, Spans, held_out, mixed, sampled, slices, text_bytes, written

#: Bounds of the fit: confirmed toxic (labelled) rows, features of the model. Unlabelled rows have no bound.
POSITIVE_ROWS, FEATURES = 4000, 1024
#: Places of features in distinct patterns that the driver holds at most.
LOCAL_PLACES = 8_000_000
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
#: A feature stands in at least so many positive rows (a twentieth of them where that is less, but two), and is so many
#: times likelier there than at large.
LEAST_ROWS, LEAST_LIFT = 5, 3.0
THRESHOLD = 0.7
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) in parts: 64-bit hashes of the lower-cased words, then of their beginnings by length."""
    data, offsets = text_bytes(texts)
    words = Spans(data, offsets, _LETTER)
    words.hashing(LOWER[data])
    yield words.doc, words.hash(words.start, words.stop)
    start, length, doc = words.start, words.stop - words.start, words.doc
    for n in PREFIXES:
        long = length >= n
        start, length, doc = start[long], length[long], doc[long]
        yield doc, mixed(words.hash(start, start + n) + np.uint64(n))


def distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[fresh], feature[fresh]


def present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All distinct (document, feature) of the texts."""
    parts = list(hashed(texts))
    return distinct(np.concatenate([d for d, _ in parts]), np.concatenate([f for _, f in parts]))


def training_rows(docs: DataFrame, labels: DataFrame, positive_rows: int) -> tuple[DataFrame, DataFrame, float]:
    """(text) of the confirmed toxic rows (a bounded number), (text) of all rows, both outside the held-out fold, and the class
    prior: the share of toxic rows among the labelled."""
    fair = labels.where(~held_out(F.col("doc_id"), 3, 1)).where("toxic is not null").select("doc_id", "toxic")
    known, toxic = fair.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    ids = written(sampled(fair.where("toxic = 1").select("doc_id").distinct(), F.col("doc_id"), positive_rows), "toxic")
    positive = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    at_large = docs.where(~held_out(F.col("doc_id"), 3, 1)).select("text")
    return written(positive.repartition(16), "positive"), at_large, (toxic or 0) / max(known, 1)


def choose_features(positive: DataFrame, at_large: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Hashes of the features that set the positive rows apart from all rows, at most `most` of them, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, n = np.unique(present(batch.column("text"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["feature", "yes"])

    n_yes, n_other = positive.count(), at_large.count()
    least = max(2, min(LEAST_ROWS, n_yes // 20))
    counts = positive.mapInArrow(run, "feature long, yes long").groupBy("feature").agg(F.sum("yes").alias("yes")).where(F.col("yes") >= least).toArrow()
    order = np.argsort(counts["feature"].to_numpy().view(np.uint64))
    candidates, yes = counts["feature"].to_numpy().view(np.uint64)[order], counts["yes"].to_numpy()[order]
    if not len(candidates):
        return candidates
    known = Known(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known.features), dtype=np.int64)
        for batch in slices(batches):
            sums += np.bincount(known.matches(batch.column("text"))[1], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["place", "n"])

    other = np.zeros(len(candidates))
    for r in at_large.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # one row for each candidate
        other[r["place"]] = r["n"]
    lift = ((yes + 0.5) / (n_yes + 1)) / ((other + 0.5) / (n_other + 1))
    strong = np.flatnonzero(lift >= LEAST_LIFT)
    best = strong[np.lexsort((candidates[strong], -yes[strong] * np.log(lift[strong])))][:most]
    return np.sort(candidates[best])


class Known:
    """The chosen features; a bitmap of their low bits passes over nearly all others."""

    BITS = 22

    def __init__(self, features: np.ndarray):
        self.features, self.map = features, None

    def __getstate__(self) -> dict:
        return {"features": self.features, "map": None}

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, place of the feature), distinct, for the known features that stand in the texts."""
        if not len(self.features):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.map is None:
            self.map = np.zeros(1 << self.BITS, dtype=bool)
            self.map[self.features & np.uint64((1 << self.BITS) - 1)] = True
        docs, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for doc, feature in hashed(texts):
            at = np.flatnonzero(self.map[feature & np.uint64((1 << self.BITS) - 1)])
            if len(at):
                place = np.minimum(np.searchsorted(self.features, feature[at]), len(self.features) - 1)
                hit = self.features[place] == feature[at]
                docs.append(doc[at[hit]])
                places.append(place[hit])
        return distinct(np.concatenate(docs), np.concatenate(places))


class Patterns:
    """Distinct sets of features: their places end to end, and how many positive and unlabelled rows have each."""

    def __init__(self, places: list[bytes], positive: np.ndarray, unlabelled: np.ndarray, features: int):
        self.count = np.array([len(p) // 4 for p in places], dtype=np.int64)
        self.places = np.frombuffer(b"".join(places), dtype=np.int32)
        self.row = np.repeat(np.arange(len(places)), self.count)
        self.rows = np.stack([positive, unlabelled]).astype(np.float64)
        self.features = features

    def values(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.places], minlength=len(self.count)) + w[-1]

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Of the positive and of the unlabelled rows (a row each): rows, sum of log(1 + e^z), sum of its slope by each feature and the bias."""
        z = self.values(w)
        loss, rise = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.stack([np.concatenate([[n.sum(), n @ loss], np.bincount(self.places, weights=(n * rise)[self.row], minlength=self.features), [n @ rise]]) for n in self.rows])


def spread_sums(table: DataFrame, w: np.ndarray) -> np.ndarray:
    """Patterns.sums over a distributed table of (places, positive, unlabelled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(w) + 2))
        for batch in batches:
            out += Patterns(batch.column("places").to_pylist(), batch.column("positive").to_numpy(), batch.column("unlabelled").to_numpy(), len(w) - 1).sums(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "x"])

    out = np.zeros(2 * (len(w) + 2))
    for r in table.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # a few numbers for each feature
        out[r["i"]] = r["x"]
    return out.reshape(2, -1)


def threshold(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The cut on the values z of rows with these counts that maximises recall squared over the share of unlabelled rows above it,
    which needs no negatives; halfway to the value below."""
    z, place = np.unique(z, return_inverse=True)
    p, u = (np.bincount(place, weights=n, minlength=len(z)) for n in (positive, unlabelled))
    if not p.sum() or not u.sum():
        return np.inf
    recall, share = np.cumsum(p[::-1])[::-1] / p.sum(), np.cumsum(u[::-1])[::-1] / u.sum()
    best = int(np.argmax(np.where(p > 0, recall**2 / np.maximum(share, 1 / u.sum()), -1)))
    return float((z[best] + z[best - 1]) / 2) if best else float(z[best])


def train(sums: Callable[[np.ndarray], np.ndarray], features: int, prior: float, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic model under the non-negative PU risk (full-batch Adam). sums: as Patterns.sums."""
    w = np.zeros(features + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not sums(w)[:, 0].all():
        w[-1] = -20.0
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    ones = None
    for t in range(1, steps + 1):
        total = sums(w)
        (loss_p, *slope_p), (loss_u, *slope_u) = total[:, 1:] / total[:, :1]
        slope_p, slope_u = np.array(slope_p), np.array(slope_u)
        if ones is None:  # a bias of 60 makes every rise 1: the mean features of the positive rows
            ones = sums(np.append(np.zeros(features), 60.0))[0, 2:] / total[0, 0]
        negative = slope_u - prior * slope_p
        # below zero the unlabelled side is overfitted: only that term is stepped, backwards
        grad = -negative if loss_u - prior * loss_p < 0 else prior * (slope_p - ones) + negative
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, local_places: int = LOCAL_PLACES) -> tuple[Known, np.ndarray]:
    """(features, weights), learnt from whole texts: a bounded number of confirmed toxic rows, and all rows outside the held-out fold.

    Scores are moved so that the best cut is THRESHOLD.
    """
    positive, at_large, prior = training_rows(docs, labels, positive_rows)
    known = Known(choose_features(positive, at_large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, place = known.matches(batch.column("text"))
            held = np.split(place, np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([h.astype(np.int32).tobytes() for h in held], pa.binary())], names=["positive", "places"])

    rows = positive.select("text", F.lit(True).alias("positive")).unionByName(at_large.select("text", F.lit(False).alias("positive")))
    table = rows.mapInArrow(run, "positive boolean, places binary").groupBy("places").agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("unlabelled"))
    table = written(table, "patterns")
    n = len(known.features)
    places = table.agg(F.sum(F.length("places") / 4 + 1)).first()[0] or 0
    if places <= local_places:
        held = table.toArrow()
        patterns = Patterns(held["places"].to_pylist(), held["positive"].to_numpy(), held["unlabelled"].to_numpy(), n)
        weights = train(patterns.sums, n, prior)
        z, of_positive, of_unlabelled = patterns.values(weights), *patterns.rows
    else:
        weights = train(lambda w: spread_sums(table, w), n, prior)
        z, of_positive, of_unlabelled = value_counts(table, weights)
    cut = threshold(z, of_positive, of_unlabelled)
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut if np.isfinite(cut) else 0.0
    return known, weights


def value_counts(table: DataFrame, w: np.ndarray, steps: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a distributed table of patterns, to a thousandth, with the positive and unlabelled rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = Patterns(batch.column("places").to_pylist(), batch.column("positive").to_numpy(), batch.column("unlabelled").to_numpy(), len(w) - 1).values(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(z / steps).astype(np.int64)), batch.column("positive"), batch.column("unlabelled")], names=["z", "positive", "unlabelled"])

    out = table.mapInArrow(run, "z long, positive long, unlabelled long").groupBy("z").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u")).toArrow()
    return out["z"].to_numpy() * steps, out["p"].to_numpy(), out["u"].to_numpy()


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels of fold 1 of 3 are never read.

    Null and empty texts score as a text without any known feature; without toxic labels all scores are near 0. Repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for batch in slices(batches):
            doc, place = known.matches(batch.column("text"))
            z = np.bincount(doc, weights=w[place], minlength=batch.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
