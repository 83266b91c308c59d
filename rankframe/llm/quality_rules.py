"""Quality rules under weak supervision.

Each rule votes good, votes bad or abstains on a document. The votes come from a latent class model: text is good, or bad in
one of several kinds, each kind the home of rules that find it together. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, whatever the number of documents) estimates, for good text and for each kind, how
often each rule votes bad; nothing bounds these rates. The posterior probability of good text replaces the demand that
every rule be passed. That bad text is a mixture is what models the dependence between rules: repeated windows and
repeated words are votes on one defect, and a text full of symbols needn't shout too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import LOWER, SPACE, Spans, mixed, slices, text_bytes, written

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Each rule: name, when it votes bad, when else it votes good (it abstains otherwise), and the kind of bad text it looks for.
RULES = (
    ("symbols", "n_symbols >= 0.10 * n_words", "n_symbols <= 0.03 * n_words", "symbols"),
    ("windows", "n_words >= 16 and n_repeat_words >= 0.3 * n_words", "n_words >= 16 and n_repeat_words <= 0.02 * n_words", "repetition"),
    ("same_word", "n_words >= 10 and n_same >= 0.3 * n_words", "n_words >= 10 and n_same <= 0.05 * n_words", "repetition"),
    ("capitals", "n_letters >= 20 and 2 * n_upper >= n_letters", "n_letters >= 20 and n_upper <= 0.15 * n_letters", "shouting"),
    ("bangs", "n_bangs >= 0.25 * n_words", "n_bangs <= 0.05 * n_words", "shouting"),
    ("lines", "n_lines >= 3 and n_dup_lines >= 0.5 * n_lines", "n_lines >= 3 and n_dup_lines = 0", "lines"),
    ("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words", "word_length"),
    ("length", "n_words < 20", "n_words >= 40", "length"),
)
#: EM starts from this trust in bad votes, smooths with so many pseudo-votes, and ends when no posterior moves by TOLERANCE.
TRUST, PSEUDO, ROUNDS, TOLERANCE = 0.9, 0.01, 300, 1e-6
#: The base rules that reject a document outright.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: The features that the operator measures and their types.
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_bangs long, n_same long, n_distinct long"
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS[1:-1].encode(), dtype=np.uint8)] = True


def _earlier(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same (doc, value) stands earlier in the array."""
    order = np.lexsort((value, doc))
    again = np.zeros(len(doc), dtype=bool)
    if len(doc):
        same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
        again[order[1:][same]] = True
    return again


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text; see MEASURED. Null counts as empty."""
    data, offsets = text_bytes(texts)
    n_docs = len(texts)
    words = Spans(data, offsets, ~SPACE)
    words.hashing()
    tokens = words.hash(words.start, words.stop)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[flags], minlength=n_docs)

    out = {"n_words": words.count, "word_chars": per_doc(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(_IS_SYMBOL[data])}
    lines = Spans(data, offsets, _NOT_NEWLINE)
    worded = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[data], out=worded[1:])
    worded = worded[lines.stop] > worded[lines.start]
    lines.sums = words.sums
    line_doc = lines.doc[worded]
    out["n_dup_lines"] = np.bincount(line_doc[_earlier(line_doc, lines.hash(lines.start[worded], lines.stop[worded]))], minlength=n_docs)
    # windows of eight words: an order-dependent mix of word hashes, told apart by document
    last = len(tokens) - WINDOW + 1
    covered = np.zeros(len(tokens) + 1, dtype=np.int64)
    if last > 0:
        window = np.zeros(last, dtype=np.uint64)
        for k in range(WINDOW):
            window = mixed(window * np.uint64(3) + tokens[k : k + last])
        inside = np.flatnonzero(words.doc[:last] == words.doc[WINDOW - 1 :])
        doc, value = words.doc[inside], window[inside]
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        twin = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
            twin[1:] |= same
            twin[:-1] |= same
        at = inside[order[twin]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = per_word(np.cumsum(covered[:-1]) > 0)
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    upper = (data >= 65) & (data <= 90)
    out["n_upper"], out["n_letters"] = per_doc(upper), per_doc((LOWER[data] >= 97) & (LOWER[data] <= 122))
    out["n_bangs"] = per_doc(data == 33)
    same = np.zeros(len(tokens), dtype=bool)
    if len(tokens) > 1:
        same[1:] = (tokens[1:] == tokens[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_same"] = per_word(same)
    out["n_distinct"] = words.count - np.bincount(words.doc[_earlier(words.doc, tokens)], minlength=n_docs)
    return out


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The counts that the rules look at, one row per document; null text counts as empty and has none, long texts are taken whole,
    repeated rows stay repeated; an empty table gives no rows."""
    names = [c.split()[0] for c in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(found[c].astype(np.int64)) for c in names]], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {MEASURED}")


def votes(features: DataFrame, rules=RULES) -> DataFrame:
    """Adds `votes`: a character per rule, + good, - bad, 0 abstains. Without a word only the rule on length votes."""
    marks = [F.when(F.expr(bad), "-").when(F.expr(good), "+").otherwise("0") for _, bad, good, _ in rules]
    marks = [m if r[0] == "length" else F.when(F.col("n_words") == 0, "0").otherwise(m) for m, r in zip(marks, rules, strict=True)]
    return features.withColumn("votes", F.concat(*marks))


def estimate(patterns: dict[str, int], rules=RULES, rounds: int = ROUNDS, trust: float = TRUST, tolerance: float = TOLERANCE) -> dict:
    """EM over vote patterns: `shares` of good text and of each kind, `errs`: how often each rule that votes votes bad (a row
    for good text, then one for each kind in `kinds`), and the `posterior` of good text for each pattern.

    An abstaining rule says nothing. Starts by trusting bad votes: a pattern with some belongs to their kinds, in equal parts,
    with probability `trust`, any other to good text.
    """
    kinds = list(dict.fromkeys(r[3] for r in rules))
    keys = sorted(patterns)
    if not keys:
        return {"kinds": kinds, "shares": np.zeros(1 + len(kinds)), "errs": np.zeros((1 + len(kinds), len(rules))), "posterior": {}}
    count = np.array([patterns[k] for k in keys], dtype=np.float64)
    mark = np.array([["+-0".index(c) for c in k] for k in keys])
    against, voted = mark == 1, mark != 2
    found = np.array([[any(m and r[3] == kind for m, r in zip(row, rules, strict=True)) for kind in kinds] for row in against], dtype=np.float64)
    some = found.any(axis=1, keepdims=True)
    bad = np.where(some, trust * found / np.maximum(found.sum(axis=1, keepdims=True), 1), (1 - trust) / len(kinds))
    belongs = np.hstack([1 - bad.sum(axis=1, keepdims=True), bad])
    for _ in range(rounds):
        held = count[:, None] * belongs
        shares = (held.sum(axis=0) + PSEUDO) / (count.sum() + PSEUDO * (1 + len(kinds)))
        errs = (held.T @ against + PSEUDO) / (held.T @ voted + 2 * PSEUDO)
        says = np.log(shares) + (against & voted) @ np.log(errs).T + (~against & voted) @ np.log(1 - errs).T
        fresh = np.exp(says - says.max(axis=1, keepdims=True))
        fresh /= fresh.sum(axis=1, keepdims=True)
        moved, belongs = np.abs(fresh - belongs).max(), fresh
        if moved < tolerance:
            break
    return {"kinds": kinds, "shares": shares, "errs": errs, "posterior": dict(zip(keys, belongs[:, 0].tolist(), strict=True))}


def rule_verdicts(docs: DataFrame, rules=RULES, keep_above: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the measured features, base_failed, votes, posterior, kept.

    kept is false where the base rules fail, else whether the posterior of good text is over keep_above. Null and empty
    texts have no words and fail; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    features = written(votes(measured(docs), rules), "features")
    patterns = {r["votes"]: r["count"] for r in features.groupBy("votes").count().collect()}  # at most 3 ** len(rules)
    posterior = estimate(patterns, rules)["posterior"]
    known = docs.sparkSession.createDataFrame(list(posterior.items()) or [("", 0.0)], "votes string, posterior double")
    judged = features.join(F.broadcast(known), "votes").withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") > keep_above))
