"""Byte-level BPE with the tokenizers library over Arrow batches.

A space or newline that stands between other characters starts a new piece under the tokenizer's pattern, whatever
surrounds it. So each distinct word of a batch, with what stands before it, is encoded once by the library, and a text's
ids are those of its words put together; texts with other runs of white space are encoded whole. Characters of the
vocabulary stand for bytes by the byte-to-character table, which decoding reverses; so characters split over
tokens come back whole. offsets() maps tokens to characters of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.common import kept_as, slices

#: Entries of the worker's table of words; it starts anew when it is full.
MOST_WORDS = 500_000
#: Distinct new words in one call of the library.
WORDS_AT_ONCE = 20_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The tokenizer file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


class Codec:
    """Encodes and decodes with one vocabulary; built in each worker on first use. Ids are little-endian 32-bit integers."""

    kept: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_characters()
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        known = {i: bytes(table[c] for c in token) for token, i in vocabulary.items() if all(c in table for c in token)}
        values = [known.get(i, b"") for i in range(max(known) + 1)]
        self.length = np.array([len(v) for v in values], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(values), dtype=np.uint8)
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encodes new words, many in one text; the bytes that their tokens stand for tell where each word ends."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = [w if w[0] == "\n" else f" {w}" for w in words[at : at + WORDS_AT_ONCE]]
            ids = np.frombuffer(self.whole(["".join(part)])[0], dtype="<u4")
            ends = np.cumsum(self.length[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) for w in part]), side="right").tolist()
            data, last = ids.tobytes(), 0
            for word, cut in zip(words[at : at + WORDS_AT_ONCE], cuts, strict=True):
                self.words[word] = data[4 * last : 4 * cut]
                last = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A word is kept by what follows its space, or by its newline and what follows that."""
        cut = [f"\n{t}".replace("\n", " \n").split(" ")[1:] for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        fresh = set(chain.from_iterable(cut)).difference(self.words)
        odd = {w for w in fresh if not w or w[-1].isspace() or w[0] != "\n" and w[0].isspace() or w[0] == "\n" and w[1:2].isspace()}
        fresh -= odd
        # a text starts without the newline that was set before it
        first = {t[0] for t in cut} - odd
        lead = dict(zip(first, self.whole([w[1:] for w in first]), strict=True)) if first else {}
        self.learn(sorted(fresh))
        plain = [k for k, ws in enumerate(cut) if not (odd and not odd.isdisjoint(ws))]
        out: list[bytes] = [b""] * len(texts)
        get = self.words.__getitem__
        for k in plain:
            out[k] = lead[cut[k][0]] + b"".join(map(get, cut[k][1:]))
        rest = sorted(set(range(len(texts))).difference(plain))
        for k, ids in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow array one after another, and how many each has: encode() with words split, told apart and
        put together by columns. A text of other white space stands as one word of its own."""
        values = pc.binary_join_element_wise("\n", texts.fill_null(""), "")
        pieces = pc.split_pattern(pc.replace_substring(values, "\n", " \n"), " ")
        coded = pieces.flatten().dictionary_encode()
        index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        at = pieces.offsets.to_numpy().astype(np.int64)
        at, ends = at[:-1] - at[0], at[1:] - at[0]
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        fresh = [w for w in names if w not in self.words]
        odd = {w for w in fresh if not w or w[-1].isspace() or w[0] != "\n" and w[0].isspace() or w[0] == "\n" and w[1:2].isspace()}
        self.learn([w for w in fresh if w not in odd])
        strange = np.fromiter((w in odd for w in names), dtype=bool, count=len(names))[index]
        strange[at] = False  # what stands before the first newline is no word
        whole = np.logical_or.reduceat(strange, at) if len(at) else strange
        first, where = np.unique(index[at[~whole] + 1], return_inverse=True)
        rest = [texts[k].as_py() or "" for k in np.flatnonzero(whole).tolist()]
        index[at[~whole] + 1] = len(names) + where
        index[at[whole]] = len(names) + len(first) + np.arange(len(rest))
        kept = np.ones(len(index), dtype=bool)
        kept[at[~whole]] = False
        for k in np.flatnonzero(whole).tolist():
            kept[at[k] + 1 : ends[k]] = False
        empty = b""
        data = [self.words.get(w, empty) for w in names] + self.whole([names[k][1:] for k in first.tolist()]) + self.whole(rest)
        length = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        table, start = np.frombuffer(b"".join(data), dtype="<u4"), np.cumsum(length) - length
        sizes = np.where(kept, length[index], 0)
        counts = np.add.reduceat(sizes, at) if len(at) else sizes
        index = index[kept]
        sizes = length[index]
        place = np.repeat(start[index] - (np.cumsum(sizes) - sizes), sizes)
        return table[place + np.arange(len(place))], counts

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        every = np.frombuffer(b"".join(ids), dtype="<u4")
        length = self.length[every]
        ends = np.cumsum(length)
        place = np.repeat(self.start[every] - (ends - length), length)
        data = self.table[place + np.arange(len(place))].tobytes()
        counts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
        cuts = np.concatenate([[0], ends])[counts].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(first, end) character of each token, by the library; a split character belongs to all its tokens."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", offsets: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns of `keep` and ids array<int>; with offsets also starts and ends array<int>, in characters.

    Null is empty text, without ids; texts are encoded whole, however long; repeated rows stay repeated; an empty table gives no
    rows. A kept column that is called like an output has `_kept` behind its name.
    """
    file = path or vocabulary_path()
    outputs = ["ids", *(["starts", "ends"] if offsets else [])]
    names = kept_as(keep, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file)
        for batch in slices(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            columns = [*batch.columns[:-1], pa.array([np.frombuffer(x, dtype=np.int32) for x in codec.encode(texts)], pa.list_(pa.int32()))]
            if offsets:
                places = [codec.offsets(t) for t in texts]
                columns += [pa.array([[p[k] for p in ps] for ps in places], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names.values(), *outputs])

    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], F.col(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(o, T.ArrayType(T.IntegerType())) for o in outputs]]))


def decoded(tokens: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """tokens' columns of `keep` and data binary: the bytes of the ids; cast to text only if they are whole characters.

    Null or empty ids give no bytes; repeated rows stay repeated; an empty table gives no rows. A kept column called `data` has
    `_kept` behind its name.
    """
    file = path or vocabulary_path()
    names = kept_as(keep, ("data",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file)
        for batch in batches:
            data = codec.decode([np.array(ids or [], dtype="<u4").tobytes() for ids in batch.column("_ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], names=[*names.values(), "data"])

    rows = tokens.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], F.col("ids").alias("_ids"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("data", "binary"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, in one pass over the batches.

    Null text is encoded as empty: no ids, digests of nothing. Repeated rows stay repeated; other columns are ignored.
    """
    file = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(file)
        for batch in slices(batches):
            ids = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            of_ids = [hashlib.sha256(x).hexdigest() for x in ids]
            of_bytes = [hashlib.sha256(x).hexdigest() for x in codec.decode(ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
