"""Records of chunks, made of whole documents in steps of numpy: a character is read once, however many chunks it stands in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from rankframe.functions import lang
from rankframe.functions import text as T
from rankframe.operators.chunking import LEAST, MOST, OVERLAP, TARGET

#: Bytes of text that one step holds at most (a longer document is one step of its own).
STEP_BYTES = 1 << 20
#: Keywords of a chunk, the letters that one has at least, and those of a long word.
MOST_KEYWORDS, LEAST_LETTERS, LONG = 8, 4, 9
#: Bits of a character: a capital, comma or colon; an ASCII digit; white space; what words are made of; a digit of any script; what ends a sentence.
MARK, DIGIT, SPACE, WORD, NUMBER, END = (1 << k for k in range(6))
#: Words that vote for languages, each with a bit (64 at most).
VOTERS = sorted({w for ws in lang.KEYWORDS.values() for w in ws})
VOTES = {w: 1 << k for k, w in enumerate(VOTERS)}
BITS = np.array([*VOTES.values(), 0], dtype=np.uint64)
WHITE = " \t\n\v\f\r"
BLANKS, BETWEEN = re.compile(r"  +"), re.compile(r"([.!?])(?:[\n\v\f]\s*| \s+)", re.ASCII)
HYPHEN, RUN = re.compile(r"-\s*\n\s*", re.ASCII), re.compile(r"\s+", re.ASCII)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The bits of all characters; none from the fourth plane on is a letter or a number."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[:0x40000] = [(c[0] in "LN") * WORD | (c == "Nd") * NUMBER for c in map(unicodedata.category, map(chr, range(0x40000)))]
    for bit, chars in ((MARK, "ABCDEFGHIJKLMNOPQRSTUVWXYZ,:"), (DIGIT, "0123456789"), (SPACE, WHITE), (WORD, "_"), (END, ".!?")):
        out[[ord(c) for c in chars]] |= bit
    return out


def records(docs: DataFrame, text: str = "text", target: int = TARGET, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP, section_title: Column | None = None, page: Column | None = None, domain: Sequence[str] = ()) -> DataFrame:
    """(doc_id, chunk_index, text) of `chunking.chunks` with what `chunking.described` adds to them, to the same values.

    section_title and page are made of doc_id and chunk_index. Patterns are looked for by Spark, those of numeric data in chunks that hold a digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                yield described(some, target, least, most, overlap)

    schema = T_.StructType([docs.schema["doc_id"], *T_._parse_datatype_string("chunk_index int, text string, language string, keywords array<string>, has_number boolean, text_density double, normalized_text string").fields])
    title = F.lit("DOCUMENT_CONTENT") if section_title is None else section_title
    where = F.lit(1) if page is None else page
    t = F.col("text")
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, schema).select(
        "doc_id", "chunk_index", "text", "language", where.alias("page"), title.alias("section_title"), T.section_number(title).alias("section_code"), "keywords", (F.col("has_number") & T.matches_any(t)).alias("has_numeric_data"),
        (T.matches_any(t, domain) if domain else F.lit(False)).alias("has_domain_patterns"), "text_density", "normalized_text", F.concat_ws(".", where, F.col("chunk_index") + 1).alias("citation_id"),
    )


def slices(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same documents in runs of at most so many bytes of text, or of one document."""
    sizes = sums(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def sums(values: np.ndarray) -> np.ndarray:
    """What stands before each place, and in all."""
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def counted(n: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def normalised(text: str) -> str:
    """`text.normalised`, with one space between sentences."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.replace("\t", " ")
    if "  " in text:
        text = BLANKS.sub(" ", text)
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    text = text.strip(WHITE)
    return BETWEEN.sub(r"\1 ", text) if any(c in text for c in "\n\v\f") else text


def bounds(sizes: list[int], target: int, least: int, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The first and last sentence of each chunk of a document, by the rule of `chunking.packed`."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > target and held >= least or held >= most:
            yield start, i - 1
            start = i - min(i - start, overlap)
            held = sum(sizes[start:i])
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - 1


def described(batch: pa.RecordBatch, target: int = TARGET, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> pa.RecordBatch:
    """Records of all chunks of a few documents (doc_id, text).

    All sentences of all documents stand in one text with a space between, so that a chunk is a slice of it and cuts no word and no run of digits or
    white space. No sentence has white space at its ends.
    """
    texts = [normalised(t) for t in batch.column("text").to_pylist()]
    text = " ".join(filter(None, texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = codes(text)
    kind = kinds()[points]
    last = np.zeros(len(text) + 1, dtype=bool)  # the space behind a sentence, or the end
    last[1:-1] = (points[1:] == 32) & (kind[:-1] & END > 0)
    last[np.cumsum(sizes[sizes > 0] + 1) - 1] = len(text) > 0
    ends = np.flatnonzero(last)
    starts = np.append(0, ends + 1)[:-1]
    n = np.zeros(len(texts), dtype=np.int64)  # sentences of each document
    n[sizes > 0] = np.diff(np.searchsorted(ends, np.append(-1, np.cumsum(sizes[sizes > 0] + 1) - 1), side="right"))
    lengths, before = (ends - starts).tolist(), sums(n).tolist()
    cuts = [list(bounds(lengths[i:j], target, least, most, overlap)) for i, j in zip(before, before[1:])]
    many = np.fromiter(map(len, cuts), np.int64, len(cuts))
    doc = np.repeat(np.arange(len(cuts)), many)
    cut = np.array([c for cs in cuts for c in cs], dtype=np.int64).reshape(-1, 2) + sums(n)[doc][:, None]
    lo, hi = starts[cut[:, 0]], ends[cut[:, 1]]
    lowered = text.lower()
    numbers, longer = sums(kind & NUMBER > 0), sums(points == 0x130)  # the one character that lower case makes longer
    columns = {
        "doc_id": batch.column("doc_id").take(pa.array(doc)), "chunk_index": pa.array(counted(many).astype(np.int32)), "text": sliced(text, lo, hi), "language": languages(text, lowered, points, longer, lo, hi),
        "keywords": keywords(lowered, longer, lo, hi), "has_number": pa.array(numbers[hi] > numbers[lo]), "text_density": densities(kind, lo, hi), "normalized_text": flat(text, points, kind, starts, ends, cut),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sliced(text: str, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    return pa.array([text[i:j] for i, j in zip(lo.tolist(), hi.tolist())], pa.string())


def flat(text: str, points: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> pa.Array:
    """`text.for_metadata` of each chunk. Most sentences hold single spaces only; the others are made anew."""
    space = kind & SPACE > 0
    space[1:] &= (points[1:] != 32) | space[:-1]
    odd = sums(space)
    places = np.flatnonzero(odd[ends] > odd[starts])
    if len(places):
        parts = [text[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        for k in places.tolist():
            parts[k] = RUN.sub(" ", HYPHEN.sub("", parts[k]))
        text = " ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.append(0, ends + 1)[:-1]
    return sliced(text, starts[cut[:, 0]], ends[cut[:, 1]])


def densities(kind: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """`text.density` of each chunk; a run of digits and a long word are counted where they begin."""
    digit = kind & DIGIT > 0
    marks = (kind & MARK).astype(np.int64) + digit
    marks[1:] -= digit[1:] & digit[:-1]
    edges = np.concatenate([[-1], np.flatnonzero(kind & SPACE), [len(kind)]])
    marks[edges[:-1][np.diff(edges) > LONG] + 1] += 1
    total = sums(marks)
    return pa.array(np.minimum((total[hi] - total[lo]) / np.maximum(hi - lo, 1) * 100, 1.0))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def keywords(lowered: str, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The most frequent words of each chunk, ties by word, of those that `text.keyword_tokens` finds and that are no stop words."""
    points = codes(lowered)
    lo, hi = lo + longer[lo], hi + longer[hi]
    word = np.zeros(len(points) + 2, dtype=bool)
    word[1:-1] = kinds()[points] & WORD > 0
    edges = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edges[::2], edges[1::2]
    other = sums((points < 97) | (points > 122))
    fit = (end - begin >= LEAST_LETTERS) & (other[end] == other[begin])
    begin, size = begin[fit], (end - begin)[fit]
    inside = np.zeros(len(points) + 1, dtype=np.int8)
    inside[begin], inside[begin + size] = 1, -1
    found = strings(points[np.cumsum(inside[:-1], dtype=np.int8) > 0].astype(np.uint8), sums(size)).dictionary_encode()
    names = found.dictionary
    order, stop = pc.sort_indices(names).to_numpy(), pc.is_in(names, pa.array(T.KEYWORD_STOP_WORDS, names.type)).to_numpy(zero_copy_only=False)
    token, width = found.indices.to_numpy(), max(len(names), 1)
    begin, token = begin[~stop[token]], np.argsort(order)[token[~stop[token]]]  # words as places in their order
    first = np.searchsorted(begin, lo)
    many = np.searchsorted(begin, hi) - first
    held = np.sort(np.repeat(np.arange(len(lo)) * width, many) + token[np.repeat(first, many) + counted(many)])
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(held)))
    chunk, token = np.divmod(held[at], width)
    each = np.bincount(chunk, minlength=len(lo))
    best = np.argsort(chunk * (n.max(initial=0) + 1) - n, kind="stable")[counted(each) < MOST_KEYWORDS]  # by chunk and number; words stand in order already
    return pa.ListArray.from_arrays(pa.array(sums(np.minimum(each, MOST_KEYWORDS)).astype(np.int32)), names.take(pa.array(order[token[best]])).cast(pa.string()))


def languages(text: str, lowered: str, points: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """`lang.detect` of each chunk. Its votes are bits, joined over the words that its sample holds whole; the last one may be cut."""
    stop = np.minimum(hi, lo + lang.SAMPLE)
    blanks = np.flatnonzero(points == 32)
    begin, end = np.append(0, blanks + 1), np.append(blanks, len(points))
    data = np.frombuffer(f"{lowered} ".encode(), dtype=np.uint8)
    votes = BITS[pc.index_in(strings(data, np.append(0, np.flatnonzero(data == 32) + 1)), pa.array([f"{w} " for w in VOTERS], pa.large_string())).fill_null(len(VOTERS)).to_numpy()]
    first, last = np.searchsorted(begin, lo), np.searchsorted(end, stop, side="right")
    held = np.bitwise_or.reduceat(np.append(votes, np.uint64(0)), np.stack([first, last], axis=1).ravel())[::2] if len(lo) else np.zeros(0, np.uint64)
    held[last == first] = 0
    part = np.flatnonzero(stop < hi)
    held[part] |= np.array([VOTES.get(text[i:j].lower(), 0) for i, j in zip(begin[last[part]].tolist(), stop[part].tolist())], dtype=np.uint64)
    counts = np.stack([np.bitwise_count(held & np.uint64(sum(VOTES[w] for w in set(ws)))) for ws in lang.KEYWORDS.values()])
    out = np.where(counts.max(axis=0) >= lang.LEAST_VOTES, np.array(list(lang.KEYWORDS), dtype=object)[counts.argmax(axis=0)], "en")
    if points.max(initial=0) > 0x3FF:
        size = stop - lo + longer[stop] - longer[lo]
        for name, pattern, share in reversed(lang.SCRIPTS):
            inside = np.zeros(len(points), dtype=bool)
            for low, high in re.findall(r"\\u(\w{4})-\\u(\w{4})", pattern):
                inside |= (points >= int(low, 16)) & (points <= int(high, 16))
            total = sums(inside)
            out[total[stop] - total[lo] > size * share] = name
    out[hi - lo < lang.LEAST_CHARS] = "en"
    return pa.array(out, pa.string())
