"""Scoring text with a hierarchical Pitman-Yor model.

A token's context is the word before it (or the start of the text), if that stands often enough to have a restaurant (`least`, 1: every
word has one); other tokens are customers of the root. Every context has a restaurant of its own, whose dishes are words; all of them
share one parent, the root restaurant over uniform words. Every table of a context restaurant is one customer of the root.

Gibbs sampling redraws, dish by dish, on how many tables the dish's customers sit, from the distribution that the Chinese
restaurant gives this number when all other seats are held (Stirling numbers times the probability of opening each table).
Dishes are rows of a distributed table that grows with the corpus, and are swept in parallel: within a round the totals of the
restaurants stand as the round before left them; only these totals (a number for each frequent context) visit the driver. The
predictive probabilities of all samples are averaged.

Restaurants of the other contexts, as many as there are words, stay distributed: a context's tokens come together in one task, which
sweeps its restaurant alone, its own totals held exactly. They are swept twice, with one discount for all of them: for the root's
customers, by the words' shares of the training tokens, and for the scores, by the root that was fitted. In these draws (not in the
scores) words that no task holds have the mean probability of such words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import LOWER, SPACE, Spans, held_out, mixed, slices, text_bytes, written

#: Every task holds the totals of words that are one in so many training tokens or more; those of the other words are joined by the word.
#: Words that stand less often than the second number have no restaurant, unless score() is told otherwise.
CONTEXT_SHARE, CONTEXT_COUNT = 40_000, 8
#: Rounds that settle the totals, sweeps in each, and samples that are averaged after so many more sweeps.
ROUNDS, SWEEPS, SAMPLES = 3, 3, 10
STRENGTH = 1.0
#: Contexts: none (the root's own customers), the start of a text, then the frequent words.
NONE, START = 0, 1
#: The end of a text is a token; its hash stands for a word that no text holds.
END, END_HASH = "\n", np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task counts before it hands on what it has; entries and words, the most frequent ones, that every task holds; bits of the
#: map of the frequent words' other entries.
STEP_TOKENS, HOT_ENTRIES, HOT_WORDS, MAP_BITS = 800_000, 1_500_000, 100_000, 1 << 26
#: Bytes of a file's dictionary: the numbers of the rows whose tokens stand in it.
ROW_NUMBERS = 8 << 20
#: Entries of the lexicon that one sweep takes together.
STEP_ENTRIES = 300_000
#: Up to this many customers of a dish the number of tables is drawn from its exact distribution; more (a few pairs of frequent words) are
#: seated one after the other, which opens somewhat more tables, and from the 64th in blocks of this share of those before.
EXACT, SINGLY, BLOCK_SHARE = 64, 64, 1 / 16


def tables(customers: np.ndarray, base: np.ndarray, discount: float, mass: np.ndarray | float, seed: np.ndarray) -> np.ndarray:
    """Tables after seating each dish's customers in turn.

    base: the parent's probability of the dish; mass: strength plus discount times all tables of the restaurant. Draws
    come from a hash of the seed and the customer's turn, so they don't depend on how rows are dealt to tasks.
    """
    out = np.minimum(customers, 1).astype(np.float64)
    opening = np.broadcast_to(np.asarray(mass, dtype=np.float64), customers.shape) * base
    live = np.flatnonzero(customers > 1)
    turn = 1
    while len(live):
        block = 1 if turn < SINGLY else max(1, int(turn * BLOCK_SHARE))
        seats = np.minimum(customers[live] - turn, block)
        new = opening[live] / (opening[live] + np.maximum(turn - discount * out[live], 1e-9))
        out[live] += np.floor(seats * new + unit(seed[live] + np.uint64(turn)))
        turn += block
        live = live[customers[live] > turn]
    return np.minimum(out, customers)


def unit(seed: np.ndarray) -> np.ndarray:
    return (mixed(seed) >> np.uint64(11)) * 2.0**-53


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """[n, t]: the logarithm of the generalised Stirling number of n customers on t tables; -inf where there is none."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - discount * t)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n + 1, 1 : n + 2], out[n, : n + 1])
    return out


def redrawn(customers: np.ndarray, now: np.ndarray, base: np.ndarray, discount: float, all_tables: np.ndarray, seed: np.ndarray, stirling: np.ndarray) -> np.ndarray:
    """A Gibbs draw of every dish's tables, all_tables (of its restaurant, with its own `now`) held.

    P(t) is proportional to S(n, t) times, for each table after the first, (strength + discount * tables so far) * base.
    """
    out = np.minimum(customers, 1).astype(np.float64)
    others = np.broadcast_to(np.asarray(all_tables, dtype=np.float64), customers.shape) - now
    some = np.flatnonzero(customers > 1)
    size = np.minimum(customers[some], EXACT + 1)
    order = some[np.argsort(size, kind="stable")]
    sizes, counts = np.unique(size, return_counts=True)
    edges = np.concatenate([[0], np.cumsum(counts)])
    many = order[:0]
    for n, first, last in zip(sizes.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        at = order[first:last]
        if n > EXACT:
            many = at
        else:
            steps = np.log((STRENGTH + discount * (np.maximum(others[at], 0)[:, None] + np.arange(1, n))) * base[at][:, None])
            weight = np.exp(np.concatenate([np.zeros((len(at), 1)), np.cumsum(steps, axis=1)], axis=1) + (stirling[n, 1 : n + 1] - stirling[n, 1]))
            below = np.cumsum(weight, axis=1)
            out[at] = 1 + (below[:, :-1] < (unit(seed[at]) * below[:, -1])[:, None]).sum(axis=1)
    if len(many):
        out[many] = tables(customers[many], base[many], discount, STRENGTH + discount * others[many], seed[many])
    return out


def tokens_of(texts: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """(spans of the words, hash of every token of texts put end to end, the number of each text, its span or -1 at ends)."""
    data, offsets = text_bytes(texts)
    words = Spans(data, offsets, ~SPACE)
    words.hashing(LOWER[data])
    count = words.count + 1
    end = np.cumsum(count) - 1
    span = np.full(int(count.sum()), -1, dtype=np.int64)
    inside = np.ones(len(span), dtype=bool)
    inside[end] = False
    span[inside] = np.arange(len(words.start))
    hashes = np.full(len(span), END_HASH, dtype=np.uint64)
    hashes[inside] = words.hash(words.start, words.stop)
    return words, hashes, count, span


def contexts_of(hashes: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The context of each token: START, or 2 and more by the place of the word before in `known` (hashes, rising), or NONE."""
    own = np.full(len(hashes), NONE, dtype=np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        own = np.where(known[place] == hashes, place + 2, NONE)
    out = np.concatenate([[NONE], own[:-1]]) if len(own) else own
    out[np.cumsum(count) - count] = START
    return out


def spelt(words: Spans, span: np.ndarray) -> pa.Array:
    """The lower-cased words of the spans; END for -1."""
    start, stop = np.where(span < 0, 0, words.start[span] if len(words.start) else 0), np.where(span < 0, 0, words.stop[span] if len(words.start) else 0)
    size = np.where(span < 0, 1, stop - start)
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    data = LOWER[words.data[np.minimum(place, max(len(words.data) - 1, 0))]] if len(words.data) else np.zeros(len(place), dtype=np.uint8)
    data[offsets[:-1][span < 0]] = ord(END)
    return pa.Array.from_buffers(pa.large_string(), len(span), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def counted(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """Counts over the training texts (text): (h, n) of each word hash where known is None, else (w, k, n, c, word): n = c of each word hash in
    each context but NONE, the word itself in one of its rows (of none, if it has no other). A task adds up what it meets, a bounded number
    of tokens at a time."""

    def summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at, place = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        return key, at, np.bincount(place, weights=np.concatenate([x[1] for x in held]), minlength=len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each: list[tuple] = []
        pairs: list[tuple] = []

        def drained() -> pa.RecordBatch:
            h, at, c = summed(each)
            if known is None:
                return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "n"])
            _, first, n = summed(pairs)
            w, k = (np.concatenate([x[j] for x in pairs])[first] for j in (2, 3))
            order = np.argsort(w)  # equal words side by side
            w, k, n = w[order], k[order], n[order]
            own = starts(w)
            place = np.searchsorted(h, w[own])  # h rises and has every word
            alone_ = np.delete(np.arange(len(h)), place)
            spelling = np.concatenate([np.full(len(w), -1), at[alone_]])
            spelling[own] = at[place]
            zeros = np.zeros(len(alone_), dtype=np.int64)
            c = pa.array(np.concatenate([n, zeros]))
            word = pa.concat_arrays([x[2] for x in each]).take(pa.array(spelling, mask=spelling < 0))
            columns = [pa.array(np.concatenate([w, h[alone_]]).view(np.int64)), pa.array(np.concatenate([k, zeros + NONE]).astype(np.int32)), c, c, word]
            return pa.RecordBatch.from_arrays(columns, names=["w", "k", "n", "c", "word"])

        size = 0
        for batch in slices(batches):
            words, hashes, count, span = tokens_of(batch.column("text"))
            h, first, c = np.unique(hashes, return_index=True, return_counts=True)
            each.append((h, c) if known is None else (h, c, spelt(words, span[first])))
            if known is not None:
                k = contexts_of(hashes, count, known)
                some = np.flatnonzero(k != NONE)
                key, first, n = np.unique(entry_keys(hashes[some], k[some]), return_index=True, return_counts=True)
                pairs.append((key, n, hashes[some[first]], k[some[first]]))
            size += len(hashes)
            if size > STEP_TOKENS:
                yield drained()
                each.clear()
                pairs.clear()
                size = 0
        if each:
            yield drained()

    return docs.select("text").mapInArrow(run, "h long, n long" if known is None else "w long, k int, n long, c long, word string")


def context_words(counts: DataFrame, total: int, share: int = CONTEXT_SHARE, least: int = CONTEXT_COUNT) -> np.ndarray:
    """Hashes, rising, of the words whose restaurants every task holds, from the words' counts (h, n), of `total` tokens. Without
    training text there is none; the restaurants of all other words are in following()."""
    top = counts.where((F.col("n") >= max(least, -(-total // share))) & (F.col("h") != int(END_HASH.view(np.int64)))).select("h").toArrow()  # at most `share` rows
    return np.sort(top["h"].to_numpy().view(np.uint64))


def whole(batches: Iterator[pa.RecordBatch], key: str, most: int = STEP_ENTRIES) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by the key, in batches of about `most` or more that leave no key's rows apart."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, most
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= limit:
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = joined.column(key).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1])
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            if cut:
                yield joined.slice(0, cut)
            held, size = [joined.slice(cut)], len(joined) - cut
            limit = max(most, 2 * size)
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def following(rows: DataFrame, known: np.ndarray, bases: Bases) -> DataFrame:
    """(h, c, ws, ns, ms, rids): for the hash of each word that is not in `known`, the training tokens behind it; of each word there (its place
    in `bases`, else its hash) the training tokens and all tokens; and, word by word, the rows (rid, odd for training) of the tokens. A row
    of the table holds less than about one in CONTEXT_SHARE of the tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(bases)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, hashes, count, _ = tokens_of(batch.column("text"))
            some = np.flatnonzero(contexts_of(hashes, count, known) == NONE)
            doc = np.repeat(np.arange(batch.num_rows), count)[some]
            w = shared.value.places(hashes[some])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[some - 1].view(np.int64)), pa.array(w.view(np.int64)), pa.array(batch.column("rid").to_numpy()[doc])], names=["h", "w", "rid"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "h"):
            h, w, rid = (batch.column(c).to_numpy() for c in ("h", "w", "rid"))
            first = starts(h, w)
            n = np.add.reduceat(rid & 1, first)
            own = starts(h[first])
            ends = np.append(own, len(first)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (w[first], n, np.diff(np.append(first, len(h))))]
            rids = pa.ListArray.from_arrays(pa.array(np.append(first, len(h))[ends].astype(np.int32)), pa.array(rid))
            yield pa.RecordBatch.from_arrays([pa.array(h[first][own]), pa.array(np.add.reduceat(n, own)), *lists, rids], names=["h", "c", "ws", "ns", "ms", "rids"])

    spread = rows.select("rid", "text").mapInArrow(tokens, "h long, w long, rid long").repartition("h").sortWithinPartitions("h", "w")
    return spread.mapInArrow(grouped, "h long, c long, ws array<long>, ns array<long>, ms array<long>, rids array<long>")


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def alone(k: np.ndarray, n: np.ndarray, base: np.ndarray, discount: float, seed: np.ndarray, turns: int) -> Iterator[np.ndarray]:
    """The tables of each entry (restaurant k, n customers) after each of so many sweeps, all entries of the restaurants being here."""
    opened = np.minimum(n, 1).astype(np.float64)
    drawn = np.flatnonzero(n > 1)
    stirling = log_stirling(discount)
    for turn in range(turns):
        all_tables = np.bincount(k, weights=opened)
        opened[drawn] = redrawn(n[drawn], opened[drawn], base[drawn], discount, all_tables[k[drawn]], mixed(seed[drawn] + np.uint64(turn)), stirling)
        yield opened


class Bases:
    """Probabilities of the words that every task holds (by hashes, rising), and the mean of all others."""

    def __init__(self, hashes: np.ndarray, p: np.ndarray, words: int):
        self.hashes = hashes
        self.p = np.append(p, np.clip(1 - p.sum(), 0, 1) / max(words - len(p), 1) + 1e-300)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word that is held, the hash of the others (which is never so small)."""
        if not len(self.hashes):
            return hashes
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place.astype(np.uint64), hashes)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, probability, whether it is held) of each word."""
        held = places < np.uint64(len(self.hashes))
        at = np.where(held, places, 0).astype(np.int64)
        return np.where(held, self.hashes[at], places) if len(self.hashes) else places, np.where(held, self.p[at], self.p[-1]), held


def seated(others: DataFrame, bases: Bases, discount: float, least: int) -> DataFrame:
    """(w, k, n, c, word): of following(), what each word brings to the root (k is NONE): n tables for its c customers, or these themselves
    where the context has no restaurant."""
    shared = others.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "ns"):
            n = batch.column("ns").flatten().to_numpy()
            k = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("ns").offsets.to_numpy()))
            w, base, _ = shared.value.of(batch.column("ws").flatten().to_numpy().view(np.uint64))
            for opened in alone(k, n, base, discount, entry_keys(w, batch.column("h").to_numpy().view(np.uint64)[k]), SWEEPS):
                pass
            opened = np.where(batch.column("c").to_numpy()[k] < least, n, opened)
            w, place = np.unique(w[n > 0], return_inverse=True)
            opened, n = (np.bincount(place, weights=x[n > 0], minlength=len(w)).astype(np.int64) for x in (opened, n))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), NONE, dtype=np.int32)), pa.array(opened), pa.array(n), pa.nulls(len(w), pa.string())], names=["w", "k", "n", "c", "word"])

    return others.select("h", "c", "ws", "ns").mapInArrow(run, "w long, k int, n long, c long, word string")


def word_counts(train: DataFrame, known: np.ndarray, others: DataFrame) -> DataFrame:
    """(w, word, c, ks, ns): every token of the training texts with its hash and count, the contexts it has and its count in each; in NONE, the
    root's customers that `others` (of seated()) bring."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "w"):
            w, k = batch.column("w").to_numpy(), batch.column("k").to_numpy()
            first, own = starts(w, k), starts(w)
            n = np.add.reduceat(batch.column("n").to_numpy(), first)
            some = n > 0
            offsets = np.append(0, np.cumsum(np.add.reduceat(some.astype(np.int64), starts(w[first])))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[some])) for x in (k[first], n)]
            spelling = np.flatnonzero(batch.column("word").is_valid().to_numpy(zero_copy_only=False))
            _, one = np.unique(np.searchsorted(own, spelling, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(w[own]), batch.column("word").take(pa.array(spelling[one])), pa.array(np.add.reduceat(batch.column("c").to_numpy(), own)), *lists], names=["w", "word", "c", "ks", "ns"])

    spread = counted(train, known).unionByName(others).repartition("w").sortWithinPartitions("w", "k")
    return spread.mapInArrow(grouped, "w long, word string, c long, ks array<int>, ns array<long>")


class Restaurants:
    """Totals and discounts. held: tables of each context, customers and tables of the root that a round starts from; samples:
    the same after each sample of the last round."""

    def __init__(self, customers: np.ndarray, distinct: np.ndarray, v: int, discounts: tuple[float, float], tokens: float | None = None):
        self.customers, self.v, self.discounts = customers, v, discounts
        #: of the training texts; fewer are customers here where other restaurants send their tables to the root
        self.tokens = customers.sum() if tokens is None else tokens
        self.held = (distinct, float(distinct.sum() + customers[NONE]), float(v))
        self.samples: list[tuple[np.ndarray, float, float]] = []
        self.stirling = tuple(log_stirling(d) for d in discounts)

    def root(self, guests: np.ndarray, opened: np.ndarray, totals: tuple[np.ndarray, float, float]) -> np.ndarray:
        _, all_guests, all_tables = totals
        return (guests - self.discounts[0] * opened + (STRENGTH + self.discounts[0] * all_tables) / (self.v + 1)) / (STRENGTH + all_guests)

    def back_off(self, totals: tuple[np.ndarray, float, float]) -> np.ndarray:
        """What each context leaves to the root; NONE leaves all."""
        out = (STRENGTH + self.discounts[1] * totals[0]) / (STRENGTH + self.customers)
        out[NONE] = 1.0
        return out

    def inside(self, k: np.ndarray, n: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """The part of the probability of an entry that its own restaurant gives."""
        return np.where(k == NONE, 0.0, (n - self.discounts[1] * opened) / (STRENGTH + self.customers[k]))

    def sweep(self, seed: np.ndarray, word: np.ndarray, k: np.ndarray, n: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For sweeps first..last-1: (its number, tables of each word in each of its contexts, the word's customers and tables at the root).

        Starts with every dish at one table; entries of NONE are all customers of the root.
        """
        words = len(seed)
        direct = k == NONE
        opened = np.where(direct, n, np.minimum(n, 1)).astype(np.float64)
        guests = np.bincount(word, weights=opened, minlength=words)
        at_root = np.minimum(guests, 1)
        drawn = np.flatnonzero((n > 1) & ~direct)
        for turn in range(first, last):
            base = self.root(guests, at_root, self.held)
            some = word[drawn]
            opened[drawn] = redrawn(n[drawn], opened[drawn], base[some], self.discounts[1], self.held[0][k[drawn]], mixed(seed[some] + (k[drawn] * 4096 + turn).astype(np.uint64)), self.stirling[1])
            guests = np.bincount(word, weights=opened, minlength=words)
            at_root = redrawn(guests.astype(np.int64), at_root, np.full(words, 1 / (self.v + 1)), self.discounts[0], self.held[2], mixed(seed + np.uint64(1 << 40) + np.uint64(turn)), self.stirling[0])
            yield turn, opened, guests, at_root

    def sampled(self, seed: np.ndarray, word: np.ndarray, k: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The samples, numbered from 0."""
        first = ROUNDS * SWEEPS
        for turn, *state in self.sweep(seed, word, k, n, first, first + SWEEPS + SAMPLES):
            if turn >= first + SWEEPS:
                yield turn - first - SWEEPS, *state

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + 1.0 * (self.v + 1)))


def merged(batches: Iterator[pa.RecordBatch], lists: str = "ks", most: int = STEP_ENTRIES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` entries or more, so that a sweep's steps have much to do at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(lists).flatten())
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed of each word, word of each entry, its context, its count)."""
    ks, ns = batch.column("ks"), batch.column("ns")
    count = np.diff(ks.offsets.to_numpy())
    return batch.column("w").to_numpy().view(np.uint64), np.repeat(np.arange(len(count)), count), ks.flatten().to_numpy().astype(np.int64), ns.flatten().to_numpy()


def word_hashes(words: pa.Array) -> np.ndarray:
    """The hashes that tokens_of gives these words."""
    data, offsets = text_bytes(words)
    spans = Spans(data, offsets, np.ones(256, dtype=bool))
    spans.hashing()
    out = spans.hash(offsets[:-1], offsets[1:])
    out[np.asarray(words.to_numpy(zero_copy_only=False) == END)] = END_HASH
    return out


def gibbs(lexicon: DataFrame, contexts: int, tokens: int) -> Restaurants:
    """Rounds over all dishes, then the totals of the samples."""
    pairs = lexicon.select(F.explode(F.arrays_zip("ks", "ns")).alias("e")).groupBy("e.ks").agg(
        F.sum("e.ns").alias("n"), F.count(F.lit(1)).alias("d"), F.sum((F.col("e.ns") == 1).cast("long")).alias("one"), F.sum((F.col("e.ns") == 2).cast("long")).alias("two")
    )
    customers, distinct, once, twice = np.zeros(contexts), np.zeros(contexts), 0, 0
    for r in pairs.collect():  # a row for each context
        customers[r["ks"]], distinct[r["ks"]] = r["n"], 0 if r["ks"] == NONE else r["d"]
        if r["ks"] != NONE:
            once, twice = once + r["one"], twice + r["two"]
    v, in_one, in_two = (x or 0 for x in lexicon.agg(F.count(F.lit(1)), F.sum((F.size("ks") == 1).cast("long")), F.sum((F.size("ks") == 2).cast("long"))).first())
    discounts = tuple(float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.9)) for a, b in ((in_one, in_two), (once, twice)))
    model = Restaurants(customers, distinct, v, discounts, tokens)
    for part in range(ROUNDS + 1):
        shared = lexicon.sparkSession.sparkContext.broadcast(model)
        kept = SAMPLES if part == ROUNDS else 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part=part, kept=kept) -> Iterator[pa.RecordBatch]:
            m = shared.value
            sums = np.zeros((kept, contexts + 2))
            for batch in merged(batches):
                seed, word, k, n = entries(batch)
                states = m.sampled(seed, word, k, n) if kept > 1 else [((0, *x[1:]) if x[0] % SWEEPS == SWEEPS - 1 else None) for x in m.sweep(seed, word, k, n, part * SWEEPS, (part + 1) * SWEEPS)]
                for state in states:
                    if state is not None:
                        at, opened, guests, at_root = state
                        sums[at, :contexts] += np.bincount(k[k != NONE], weights=opened[k != NONE], minlength=contexts)
                        sums[at, contexts:] += guests.sum(), at_root.sum()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["i", "x"])

        totals = np.zeros(kept * (contexts + 2))
        for r in lexicon.select("w", "ks", "ns").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # a few rows for each context
            totals[r["i"]] = r["x"]
        found = [(t[:contexts], float(t[contexts]), float(t[contexts + 1])) for t in totals.reshape(kept, -1)]
        if kept == 1:
            model.held = found[0]
        else:
            model.samples = found
        shared.unpersist()
    return model


def scored_lexicon(lexicon: DataFrame, model: Restaurants) -> DataFrame:
    """(w, word, c, base_lp, root_p, ks, ns, lps): the averaged probability of each word at the root, and its log10 in each context it has."""
    shared = lexicon.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in merged(batches):
            seed, word, k, n = entries(batch)
            root, inside = np.zeros(len(seed)), np.zeros(len(k))
            for at, opened, guests, at_root in m.sampled(seed, word, k, n):
                p = m.root(guests, at_root, m.samples[at])
                root += p
                inside += m.inside(k, n, opened) + m.back_off(m.samples[at])[k] * p[word]
            lps = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(seed)))]).astype(np.int32)), pa.array(np.log10(inside / SAMPLES)))
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("word"), batch.column("c"), pa.array(m.log_base(batch.column("c").to_numpy())), pa.array(root / SAMPLES), batch.column("ks"), batch.column("ns"), lps], names=["w", "word", "c", "base_lp", "root_p", "ks", "ns", "lps"])

    return lexicon.mapInArrow(run, "w long, word string, c long, base_lp double, root_p double, ks array<int>, ns array<long>, lps array<double>")


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows above a count that at most `most` of them reach, from a histogram of the counts by eighths of a doubling."""
    step = F.floor(F.log2(count) * 8)
    left, least = most, 1 << 20
    for r in sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return rows.withColumn("held", step >= least)


def other_entries(entries: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits, packed, of the entries (w, k) that no task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = entry_keys(batch.column("w").to_numpy().view(np.uint64), batch.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key & np.uint64(MAP_BITS - 1)).astype(np.int64) + 1)], names=["place"])

    place = entries.select("w", "k").mapInArrow(run, "place long")
    parts = place.select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in parts.collect():  # at most MAP_BITS / 32768 rows of 4 KiB
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], dtype=np.uint8)
    return out


def entry_keys(hashes: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mixed(hashes * np.uint64(3) + k.astype(np.uint64))


def behind_others(others: DataFrame, bases: Bases, discount: float, least: int) -> DataFrame:
    """What the tokens of following() bring: (rid, score) of words that every task holds, and (rid, w, inside, left) of the others, whose
    probability is `inside` plus `left` times the root's."""
    shared = others.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "rids"):
            n = batch.column("ns").flatten().to_numpy()
            k = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("ns").offsets.to_numpy()))
            w, base, held = shared.value.of(batch.column("ws").flatten().to_numpy().view(np.uint64))
            c = batch.column("c").to_numpy()
            inside, tables = np.zeros(len(n)), np.zeros(len(c))
            for turn, opened in enumerate(alone(k, n, base, discount, entry_keys(w, batch.column("h").to_numpy().view(np.uint64)[k]), SWEEPS + SAMPLES)):
                if turn >= SWEEPS:
                    inside += n - discount * opened
                    tables += np.bincount(k, weights=opened, minlength=len(c))
            # the root is the same for all samples, so that the mean of the probabilities is that of the tables
            has = c >= max(least, 1)
            inside = np.where(has[k], inside / SAMPLES / (STRENGTH + c[k]), 0.0)
            left = np.where(has, (STRENGTH + discount * tables / SAMPLES) / (STRENGTH + c), 1.0)[k]
            pair = np.repeat(np.arange(len(n)), batch.column("ms").flatten().to_numpy())
            rid = batch.column("rids").flatten().to_numpy()
            done, rest = np.flatnonzero(held[pair]), np.flatnonzero(~held[pair])
            ids, place = np.unique(rid[done], return_inverse=True)
            sums = np.bincount(place, weights=np.log10(inside + left * base)[pair[done]], minlength=len(ids))
            later = [pa.concat_arrays([pa.nulls(len(ids), x.type), x]) for x in (pa.array(w[pair[rest]].view(np.int64)), pa.array(inside[pair[rest]], pa.float32()), pa.array(left[pair[rest]], pa.float32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, rid[rest]])), pa.concat_arrays([pa.array(sums, pa.float64()), pa.nulls(len(rest), pa.float64())]), *later], names=["rid", "score", "w", "inside", "left"])

    return others.mapInArrow(run, "rid long, score double, w long, inside float, left float")


def score(docs: DataFrame, folds: int = 7, remainder: int = 2, share: int = CONTEXT_SHARE, least: int = CONTEXT_COUNT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the documents out of the held-out fold (a null id never is in it). Tokens are words and one end; null text
    counts as empty, its one token is the end. Every word that stands `least` times in the training texts has a restaurant; tasks hold
    those of one in `share` tokens or more. A word that no training text holds has the probability of one
    further word of the vocabulary, as in the base score. Repeated rows count and are scored each time; an empty table gives no
    rows; other columns are ignored. perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"), folds, remainder)).alias("train"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("train").cast("long")))  # odd for training
    train = rows.where("train")
    counts = written(counted(train, None).groupBy("h").agg(F.sum("n").alias("n")), "words")
    total, v = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    known_contexts = context_words(counts, total, share, least)
    contexts = len(known_contexts) + 2
    top = most_frequent(counts, "n", HOT_WORDS).where("held").select("h", "n").toArrow()  # at most HOT_WORDS rows
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    unigrams = Bases(top["h"].to_numpy().view(np.uint64)[order], top["n"].to_numpy()[order] / max(total, 1), v)
    others = written(following(rows, known_contexts, unigrams), "following", {"parquet.dictionary.page.size": ROW_NUMBERS})
    once, twice = (F.size(F.filter("ns", lambda n, c=c: n == c)) for c in (1, 2))
    once, twice = (x or 0 for x in others.where(F.col("c") >= least).agg(F.sum(once), F.sum(twice)).first())
    discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
    lexicon = written(word_counts(train, known_contexts, seated(others, unigrams, discount, least)), "lexicon")
    model = gibbs(lexicon, contexts, total)
    lexicon = written(scored_lexicon(lexicon, model), "scored")
    ranked = most_frequent(lexicon, "c", HOT_WORDS)  # the counts, and so the words held, are those of `unigrams`
    words = ranked.where("held")
    hot = words.select("w", "base_lp", "root_p").toArrow().combine_chunks()  # at most HOT_WORDS rows
    hashes = hot["w"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    each = words.select("w", F.explode(F.arrays_zip("ks", "ns", "lps")).alias("e")).select("w", F.col("e.ks").alias("k"), F.col("e.ns").alias("n"), F.col("e.lps").alias("lp")).where(F.col("k") != NONE)
    each = most_frequent(each, "n", HOT_ENTRIES)
    held = each.where("held").select("w", "k", "lp").toArrow().combine_chunks()  # at most HOT_ENTRIES rows
    cells = np.searchsorted(hashes[order], held["w"].to_numpy().view(np.uint64)) * contexts + held["k"].to_numpy()
    cell_lp = held["lp"].to_numpy()
    by_cell = np.argsort(cells)
    others_map = other_entries(each.where("not held"))
    back = np.log10(np.mean([model.back_off(s) for s in model.samples], axis=0))
    new = float(np.log10(np.mean([model.root(np.zeros(1), np.zeros(1), s)[0] for s in model.samples])))
    no_base = float(model.log_base(np.zeros(1))[0])
    shared = spark.sparkContext.broadcast((
        known_contexts, hashes[order], np.append(hot["base_lp"].to_numpy()[order], 0.0), np.append(np.log10(hot["root_p"].to_numpy()[order]), 0.0), cells[by_cell], cell_lp[by_cell].astype(np.float32), others_map, back,
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot_hashes, base_lp, root_lp, cells, cell_lp, others, back = shared.value
        missing = len(hot_hashes)
        for batch in slices(batches):
            n = batch.num_rows
            _, h, count, _ = tokens_of(batch.column("text"))
            k = contexts_of(h, count, known)
            doc = np.repeat(np.arange(n), count)
            place = np.full(len(h), missing)
            if missing:
                place = np.minimum(np.searchsorted(hot_hashes, h), missing - 1)
                place = np.where(hot_hashes[place] == h, place, missing)
            lp = np.where((place == missing) | (k == NONE), 0.0, root_lp[place] + back[k])
            if len(cells):
                cell = place * len(back) + k
                at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                found = cells[at] == cell
                lp = np.where(found, cell_lp[at], lp)
            else:
                found = np.zeros(len(h), dtype=bool)
            # what no task holds may stand in the lexicon all the same: the map tells nearly all that do not
            open_ = (place < missing) & ~found & (k != NONE)
            bit = (entry_keys(h, k) & np.uint64(MAP_BITS - 1)).astype(np.int64)
            open_ &= (others[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            # where there is no entry: the score of a word that is held, else what its context leaves to the root
            other = np.where(open_, lp, back[k])
            lp[open_] = 0.0
            rare = np.flatnonzero(((place == missing) & (k != NONE)) | open_)
            rid = batch.column("rid").to_numpy()
            sums = [np.bincount(doc, weights=x, minlength=n) for x in (place < missing, base_lp[place], lp)]  # of tokens behind other words, no score
            every = len(rare)

            def column(values: np.ndarray, kind: pa.DataType, every: int = every) -> pa.Array:
                return pa.concat_arrays([pa.array(values, kind), pa.nulls(every, kind)])

            columns = {
                "rid": pa.array(np.concatenate([rid, rid[doc[rare]]])), "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(every, batch.column("doc_id").type)]),
                "train": column(batch.column("train").to_numpy(zero_copy_only=False), pa.bool_()), "n_tokens": column(count, pa.int64()), "n_known": column(sums[0].astype(np.int64), pa.int64()),
                "base_score": column(sums[1], pa.float64()), "score": column(sums[2], pa.float64()), "k": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(k[rare].astype(np.int32))]), "counted": pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(open_[rare])]),
                "w": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(h[rare].view(np.int64))]), "left": pa.concat_arrays([pa.nulls(n, pa.float32()), pa.array(other[rare], pa.float32())]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"rid long, doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double, k int, counted boolean, w long, left float")
    bases = Bases(hashes[order], hot["root_p"].to_numpy()[order], v)
    parts = parts.unionByName(behind_others(others, bases, discount, least), allowMissingColumns=True)
    # a document's own row has no word; a hash of its number spreads such rows over the tasks
    counted_, has_word = F.coalesce("counted", F.lit(False)), F.col("left").isNotNull()
    parts = parts.withColumn("key", F.when(F.col("w").isNull(), F.xxhash64("rid", F.lit("row"))).when(counted_, F.xxhash64("w", "k")).otherwise(F.col("w"))).drop("w")
    # words that no task holds with all their entries, and the other words' entries that no task holds
    rare_words = ranked.where("not held").select(F.col("w").alias("key2"), F.lit(False).alias("entry"), F.col("base_lp").alias("b"), F.log10("root_p").alias("root_lp"), "ks", "lps")
    entries_ = each.where("not held").select(F.xxhash64("w", "k").alias("key2"), F.lit(True).alias("entry"), F.col("lp").alias("root_lp"))
    keyed = rare_words.unionByName(entries_, allowMissingColumns=True)
    joined = parts.join(keyed, (F.col("key") == F.col("key2")) & has_word & (counted_ == F.col("entry")), "left")
    at = F.array_position("ks", F.col("k")).cast("int")
    root_lp = F.coalesce("root_lp", F.lit(new))
    inside = (
        F.when(F.col("inside").isNotNull(), F.log10(F.col("inside") + F.col("left") * F.pow(F.lit(10.0), root_lp))).when(counted_, F.coalesce("root_lp", "left"))
        .when(at > 0, F.get("lps", at - 1)).otherwise(root_lp + F.col("left"))
    )
    own = F.col("n_tokens").isNotNull()
    named = has_word & ~counted_
    summed = joined.select(
        "rid", "doc_id", "train", "n_tokens", own.cast("long").alias("copies"), F.coalesce("n_known", (named & F.col("key2").isNotNull()).cast("long")).alias("n_known"),
        F.coalesce("base_score", F.when(named, F.coalesce("b", F.lit(no_base))).otherwise(0.0)).alias("base_score"), F.coalesce("score", inside).alias("score"),
    )
    # equal rows have one number: their parts were added up, and each gets its share
    summed = summed.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"), F.sum("copies").alias("copies"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n_known, base_score, score_ = (F.col("n_known") / F.col("copies")).cast("long"), F.col("base_score") / F.col("copies"), F.col("score") / F.col("copies")
    return each.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base_score.alias("base_score"), score_.alias("score"), F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"))
