"""Language identification by a string kernel.

The blended-spectrum presence kernel counts the distinct character n-grams (1 to 4) that two texts share, divided by the root of
the product of how many distinct ones each has, so that it is 1 on equal sets. n-grams of whole code points are hashed
to HASH_BITS bits; n-grams of one hash count as one. Nystroem features against the landmarks feed one-versus-rest kernel
ridge regression; documents are scored by products of presence and landmark matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.common import held_out, kept_as, slices

#: n-gram lengths, and the bits of their hashes.
ORDERS, HASH_BITS = (1, 2, 3, 4), 20
#: Landmarks in all; they are the texts nearest to LANDMARK_CHARS long.
LANDMARKS, LANDMARK_CHARS = 96, 1500
RIDGE = 1e-3
#: Presence values that one matrix product holds (documents times n-grams of the landmarks).
BLOCK_CELLS = 1 << 24
UNKNOWN = "und"
#: In identified_documents(): the share of learned documents that may lie below the floor before it is lowered by the factor.
FLOOR_SHARE, FLOOR_FACTOR = 0.001, 0.65


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Spectrum:
    """Presence of the landmarks' n-grams in texts, and the number of distinct n-grams of each text."""

    def __init__(self, landmarks: list[str]):
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[self.hashed(t) for t in landmarks]]))
        self.table = self.stamps = None

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "table": None, "stamps": None}

    @staticmethod
    def hashed(text: str) -> np.ndarray:
        """The hash of every n-gram of the text, of all lengths, one after the other."""
        points = codepoints(text)
        value, out = np.zeros(len(points) + 1, dtype=np.uint32), []
        for order in ORDERS:
            if len(points) >= order:
                value = (value[: len(points) - order + 1] + points[order - 1 :] + np.uint32(order)) * np.uint32(0x9E3779B1)
                value ^= value >> np.uint32(15)
                out.append((value * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS))
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)

    def rows(self) -> int:
        """How many texts one matrix product takes."""
        return max(16, BLOCK_CELLS // (len(self.grams) + 1))

    def normalised(self, texts: list[str]) -> np.ndarray:
        """Presence by n-gram of the landmarks, over the root of the number of distinct n-grams of the whole text."""
        if self.table is None:
            self.table = np.full(1 << HASH_BITS, len(self.grams), dtype=np.int32)
            self.table[self.grams] = np.arange(len(self.grams))
            self.stamps = np.zeros(1 << HASH_BITS, dtype=np.int32)
        out = np.zeros((len(texts), len(self.grams) + 1), dtype=np.float32)  # the last column takes all other n-grams
        for row, text in zip(out, texts, strict=True):
            grams = self.hashed(text)
            turn = np.arange(len(grams), dtype=np.int32)
            self.stamps[grams] = turn
            fresh = grams[self.stamps[grams] == turn]  # each distinct n-gram once
            row[self.table[fresh]] = 1 / np.sqrt(max(len(fresh), 1))
        return out[:, :-1]


class Landmarks:
    """Nystroem features: the kernel with the landmarks times the inverse root of the landmarks' own kernel."""

    def __init__(self, texts: list[str]):
        self.spectrum = Spectrum(texts)
        self.matrix = self.spectrum.normalised(texts)
        values, vectors = np.linalg.eigh((self.matrix @ self.matrix.T).astype(np.float64))
        sound = values > 1e-6 * values.max()
        self.root = (vectors[:, sound] / np.sqrt(values[sound])).astype(np.float32)

    def features(self, texts: list[str]) -> np.ndarray:
        return self.spectrum.normalised(texts) @ self.matrix.T @ self.root


def _ridge_parts(rows: DataFrame, landmarks: Landmarks, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products of features (with a constant) with themselves and with -1/+1 targets, added up by place."""
    shared = rows.sparkSession.sparkContext.broadcast(landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shared.value.root.shape[1] + 1
        gram, target = np.zeros((size, size)), np.zeros((size, len(languages)))
        block = shared.value.spectrum.rows()
        for batch in slices(batches):
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.hstack([shared.value.features(part.column("text").to_pylist()), np.ones((part.num_rows, 1), dtype=np.float32)]).astype(np.float64)
                y = np.where(np.array(part.column("lang").to_pylist())[:, None] == np.array(languages)[None, :], 1.0, -1.0)
                gram += x.T @ x
                target += x.T @ y
        both = np.hstack([gram, target]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["place", "part"])

    size = landmarks.root.shape[1] + 1
    sums = np.zeros(size * (size + len(languages)))
    for r in rows.select("text", "lang").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).collect():  # one row per place of the matrix
        sums[r["place"]] = r["part"]
    both = sums.reshape(size, -1)
    return both[:, :size], both[:, size:]


class Model:
    def __init__(self, landmarks: Landmarks, weights: np.ndarray, languages: list[str]):
        self.landmarks, self.weights, self.languages = landmarks, weights.astype(np.float32), languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Softmax of four times the one-versus-rest outputs."""
        out = self.landmarks.features(texts) @ self.weights[:-1] + self.weights[-1]
        out = np.exp(4 * (out - out.max(axis=1, keepdims=True)))
        return out / out.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fits on all whole texts with a language; the landmarks, which span the features, are some of them.

    docs: (doc_id, text, lang) rows to learn from; null text, text without a letter or null lang don't count. Each language
    has as many landmarks as any other (fewer if it has fewer texts), those whose length is nearest to LANDMARK_CHARS, by
    powers of two. None if nothing is left.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    share = max(1, landmarks // len(languages))
    far = F.abs(F.round(F.log2(F.length("text") / float(LANDMARK_CHARS))))
    first = Window.partitionBy("lang").orderBy(far, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "text")
    chosen = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= share).orderBy("lang", "_r")
    marks = Landmarks([r["text"] for r in chosen.select("text").collect()])
    gram, target = _ridge_parts(rows, marks, languages)
    scale = max(gram[-1, -1], 1.0)
    weights = np.linalg.solve(gram / scale + ridge * np.eye(len(gram)), target / scale)
    return Model(marks, weights, languages)


def predicted(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns of `keep`, lang_pred and score (the probability of the language), one row per row of docs.

    Null text and text without a letter, and every text if there is no model, are `und` with score 0. A kept column that is
    called like an output has `_kept` behind its name. Repeated rows are predicted alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = kept_as(keep, ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value.landmarks.spectrum.rows() if shared.value else 1024
        for batch in slices(batches, "_text"):
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                worded = [k for k, t in enumerate(texts) if shared.value is not None and any(map(str.isalpha, t))]
                if worded:
                    found = shared.value.scores([texts[k] for k in worded])
                    lang[worded] = np.array(shared.value.languages, dtype=object)[found.argmax(axis=1)]
                    score[worded] = found.max(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*names.values(), "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], F.col(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("lang_pred", "string").add("score", "double"))


def identified_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs in a language that the model knows, with all their columns: those with a letter whose score reaches a floor.

    The floor is FLOOR_FACTOR times the score that all but FLOOR_SHARE of the documents with a lang reach. Without any lang to
    learn from there is no floor. Text that is null, empty or without a letter goes; repeated rows stay or go together.
    """
    model = fit(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", F.col("lang").isNotNull().alias("known"))
    if model is None:
        return rows.where(F.col("text").rlike(r"\p{L}")).select("doc.*")
    known = predicted(rows.where("known"), model, keep=("known",)).where(F.col("lang_pred") != UNKNOWN)
    floor = known.agg(F.percentile_approx("score", F.lit(FLOOR_SHARE), F.lit(100_000))).first()[0] or 0.0
    # scored once more, so that no copy of the texts is written
    return predicted(rows, model, keep=("doc",)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= FLOOR_FACTOR * floor)).select("doc.*")


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; fold 2 of 4 is held out of learning.

    lang_pred is `und` with score 0 for null text or text without a letter, and for all if nothing can be learned. Rows
    without an id are never held out; repeated rows are predicted alike; only text is an input; an empty table gives no rows.
    """
    source = docs if learn_from is None else learn_from
    model = fit(source.where(~held_out(F.col("doc_id"), 4, 2)))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
