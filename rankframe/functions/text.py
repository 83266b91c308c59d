"""Text expressions: normalising, tokens, features and similarity. All are Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of queries.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "have", "will", "shall", "under", "when", "into", "upon", "such", "which", "been", "were", "your", "their",
    "than", "about", "each", "within", "while", "those", "these", "there", "after", "before", "during", "because", "other", "where", "patients", "patient", "should",
    "could", "would", "might", "effect", "effects", "used", "using", "use", "dose", "doses", "per", "day", "days", "week", "weeks", "month", "months", "or", "of", "via", "onto",
)
#: Words that are no keywords of a chunk.
KEYWORD_STOP_WORDS = (
    "with", "from", "this", "that", "have", "been", "their", "there", "which", "should", "would", "could", "will", "into", "about", "after", "before", "during", "without",
    "between", "includes", "including", "because", "where", "when", "those", "these", "such", "other", "also", "more", "most",
)
#: Numeric data in prose.
NUMERIC = (
    r"\b\d+\.?\d*\s*(?:mg|mcg|µg|g|kg|ml|L|mL|%|percent|mmol|IU|units?)\b",
    r"\b\d+\.?\d*\s*(?:times|fold|×|x)\b",
    r"\bp\s*[<>=]\s*0\.\d+\b",
    r"\b\d+\.?\d*\s*[:/]\s*\d+\.?\d*\b",
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once for each row however often f uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalised(text: Column) -> Column:
    """LF line ends, single spaces, at most one blank line, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def for_metadata(text: Column) -> Column:
    """Words joined over hyphenated line ends, all white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r"\s+", " "))


def tokens(text: Column, pattern: str = "[a-z]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def without(array: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """array_except that keeps repeats."""
    return F.filter(array, lambda x: ~x.isin(list(stop)))


def holds_any(text: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0)) > 0, F.lit(False))


def matches_any(text: Column, patterns: Sequence[str] = NUMERIC) -> Column:
    """Whether a pattern stands in the text, in any case; words end where letters of any script end."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?iU){p}")
    return F.coalesce(out, F.lit(False))


def density(text: Column) -> Column:
    """Share (in percent, at most 1) of digit runs, capitals, commas, colons and words over eight letters."""
    marks = F.regexp_count(text, F.lit(r"\d+")) + F.regexp_count(text, F.lit("[A-Z]")) + F.regexp_count(text, F.lit("[,:]"))
    long_words = F.size(F.filter(words(text), lambda x: F.length(x) > 8))
    return F.least((marks + long_words) / F.greatest(F.length(text), F.lit(1)) * 100, F.lit(1.0))


def section_number(title: Column) -> Column:
    return F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)", 1)


def keyword_tokens(text: Column) -> Column:
    """Lower-cased words of four or more ASCII letters; a longer word of any script gives no piece of itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"), F.lit(0))


def page_issues(text: Column, least: int = 50) -> Column:
    """What is odd about a page's text: empty_text or very_short_text, and abrupt_ending where no sentence or line ends it. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, r"^\s+|\s+$", "")
    size = F.when(bare == "", "empty_text").when(F.length(t) < least, "very_short_text")
    return F.array_compact(F.array(size, F.when(~t.rlike(r"[.!?\n]\z"), "abrupt_ending")))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """array<float> of unit length: signed counts of the hashed words; zeros for text without a word. A stand-in for a model."""
    ws = words(F.lower(F.coalesce(text, F.lit(""))))
    slots = F.transform(ws, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("i"), (F.pmod(F.xxhash64(w, F.lit("sign")), F.lit(2)) * 2 - 1).alias("s")))
    sums = let(slots, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(xs, lambda x: x["i"] == k), F.lit(0).cast("long"), lambda acc, x: acc + x["s"])))
    return let(sums, lambda v: let(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x), lambda n: F.transform(v, lambda x: F.when(n > 0, x / F.sqrt(n)).otherwise(0.0).cast("float"))))


def first_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule of which a term stands in the text."""
    out = F.lit(default)
    for label, terms in reversed(rules):
        out = F.when(holds_any(text, terms), label).otherwise(out)
    return out


def weighted_presence(text: Column, weights: Mapping[str, float]) -> Column:
    return sum((F.when(F.contains(F.lower(text), F.lit(t)), F.lit(float(w))).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def word_similarity(a: Column, b: Column) -> Column:
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def blended_similarity(a: Column, b: Column) -> Column:
    """0.3 of the Jaccard similarity of characters and 0.7 of that of words."""
    chars = jaccard(F.split(F.lower(a), ""), F.split(F.lower(b), ""))
    return 0.3 * chars + 0.7 * word_similarity(a, b)


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_filled(*columns: Column, default: str = "") -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def citations(text: Column) -> Column:
    """Distinct (doc, pos) of [doc.pos] marks, in order of first use."""
    pattern = r"\[(\d+)\.(\d+)\]"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2)]
    return F.array_distinct(F.zip_with(*parts, lambda d, p: F.struct(d.cast("int").alias("doc_num"), p.cast("int").alias("pos"))))


def padded(vector: Column, size: int) -> Column:
    """Zeros up to `size`; null where the vector is longer or empty."""
    n = F.size(vector)
    return F.when(n.between(1, size), F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), size - n)))


def key_phrases(text: Column, window: int = 8, most_chars: int = 100, least_chars: int = 10, keep: int = 3) -> Column:
    """The longest distinct windows of words whose length fits, ties by text."""
    runs = let(words(text), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, window), " ")))
    fit = F.array_distinct(F.filter(runs, lambda x: F.length(x).between(least_chars, most_chars)))
    ranked = F.array_sort(F.transform(fit, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.slice(F.transform(ranked, lambda s: s["x"]), 1, keep)


#: Dashes, quotes, bullets and signs, each with its plain form; an empty form removes the character.
PLAIN = {
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-", "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"', "\u00bb": '"',
    "\u2022": "-", "\u25aa": "-", "\u25cf": "-", "\u25e6": "-", "\u00d7": "x", "\u00f7": "/", "\u2026": "...", "\u2264": "<=", "\u2265": ">=", "\u2260": "!=", "\u00b1": "+/-", "\u20ac": "EUR", "\u00a3": "GBP", "\u00a5": "JPY", "\u00ae": "(R)", "\u00a9": "(C)",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "\u00ad": "",
}
#: Latin letters, super- and subscripts, letterlike signs, fractions, roman numerals and ligatures: what Unicode decomposes there.
DECOMPOSED_RANGES = ((0xA0, 0x17F), (0x2070, 0x209C), (0x2100, 0x214F), (0x2150, 0x217F), (0xFB00, 0xFB06))


def plain_forms() -> dict[str, str]:
    """Each character that `canonical` replaces: its compatibility decomposition without marks, or the fixed form."""
    out = {}
    for lo, hi in DECOMPOSED_RANGES:
        for c in map(chr, range(lo, hi + 1)):
            flat = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("\u2044", "/")
            if flat != c:
                out[c] = flat
    return out | PLAIN


def canonical(text: Column) -> Column:
    """Plain characters: accents off, ligatures, fractions, roman numerals and signs spelled out, controls and zero widths removed.

    One `translate` takes all characters with one plain character or none; each of the rest is a `replace`, which does nothing
    where no such character stands (a text without them is told by one pattern). Null stays null.
    """
    forms = plain_forms()
    one = {c: f for c, f in forms.items() if len(f) == 1}
    gone = [c for c, f in forms.items() if not f] + [chr(i) for i in range(1, 32) if chr(i) not in "\t\n\r"]
    out = F.regexp_replace(text, "[\u0300-\u036f]", "")
    out = F.translate(out, "".join([*one, *gone]), "".join(one.values()))
    longer = {c: f for c, f in forms.items() if len(f) > 1}
    spelled = out
    for c, f in longer.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(f))
    return F.when(out.rlike("[" + "".join(longer) + "]"), spelled).otherwise(out)


def table_text(rows: Column, most_rows: int = 30, most_chars: int = 4000) -> Column:
    """A table, array<array<string>>, as lines of cells: its first rows, cut to a length. Null cells are empty."""
    lines = F.transform(F.slice(rows, 1, most_rows), lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    return F.left(F.array_join(lines, "\n"), F.lit(most_chars))


def table_fingerprint(rows: Column, most_rows: int = 5) -> Column:
    """The first 16 hex digits of the SHA-256 of the first rows."""
    return F.left(F.sha2(table_text(rows, most_rows, 1 << 30), 256), F.lit(16))


def redistributed_citations(text: Column) -> Column:
    """Citations grouped at the end of a paragraph go to its last sentences, one each in order; what is over stays on the last.

    Paragraphs with fewer than two trailing marks or two sentences stay as they are.
    """
    mark = r"\[\d+\.\d+\]"

    def one(p: Column) -> Column:
        tail = F.regexp_extract(p, rf"((?:\s*{mark})+)\s*\.?\s*$", 1)
        body = F.rtrim(F.left(p, F.length(F.regexp_replace(p, rf"(?:\s*{mark})+\s*\.?\s*$", ""))))
        found = F.struct(F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda x: x != "").alias("parts"), F.regexp_extract_all(tail, F.lit(mark), F.lit(0)).alias("marks"))
        return let(found, lambda s: placed(p, s["parts"], s["marks"]))

    def placed(p: Column, parts: Column, marks: Column) -> Column:
        n, m = F.size(parts), F.size(marks)
        first = F.greatest(n - m, F.lit(0))
        put = F.transform(parts, lambda x, i: F.concat(x, F.when(i < first, "").when(i == n - 1, F.concat(F.lit(" "), F.array_join(F.slice(marks, i - first + 1, F.greatest(m, F.lit(1))), ""))).otherwise(F.concat(F.lit(" "), F.coalesce(F.get(marks, i - first), F.lit(""))))))
        return F.when((m >= 2) & (n >= 2), F.array_join(put, " ")).otherwise(p)

    return F.array_join(F.transform(F.split(text, "\n\n"), one), "\n\n")


def renumbered(text: Column, mapping: Column) -> Column:
    """Citation marks [d.p] replaced through map<string,string> "d.p" -> "d.p" in one pass, so no mark is replaced twice."""
    mark = r"\[(\d+\.\d+)\]"
    gaps = F.split(text, r"\[\d+\.\d+\]")
    keys = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    new = F.transform(keys, lambda k: F.concat(F.lit("["), F.coalesce(F.element_at(mapping, k), k), F.lit("]")))
    return let(new, lambda marks: F.array_join(F.transform(gaps, lambda g, i: F.concat(F.coalesce(F.get(marks, i - 1), F.lit("")), g)), ""))


def past_answer(text: Column, fallback: str = "", most_chars: int = 200) -> Column:
    """An earlier answer in plain words: no code fences, the `answer` of a JSON object, cut; null where it is blank or the fallback."""
    bare = F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", ""), r"^\s+|\s+$", "")
    inner = F.when(bare.startswith("{"), F.coalesce(F.get_json_object(bare, "$.answer"), bare)).otherwise(bare)
    return F.when((inner != "") & (inner != F.lit(fallback)), F.left(inner, F.lit(most_chars)))


def cleaned_metadata(values: Mapping[str, Column | tuple[Column, str]]) -> Column:
    """map<string,string> of what is not null: strings, numbers and flags as text; a list as JSON of its elements that aren't null, as text.

    values: name to column, or for a list to (column, "list").
    """
    pairs = []
    for name, value in values.items():
        if isinstance(value, tuple):
            listed = F.to_json(F.transform(F.filter(value[0], lambda x: x.isNotNull()), lambda x: x.cast("string")))
            pairs.append(F.struct(F.lit(name).alias("k"), F.when(value[0].isNotNull(), listed).alias("v")))
        else:
            pairs.append(F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))


def longest(*extractions: Column) -> Column:
    """Of several extractions of one page the one with the most characters but for white space around, the first of equals; null counts as empty."""
    bare = [F.regexp_replace(F.coalesce(e, F.lit("")), r"^\s+|\s+$", "") for e in extractions]
    sized = F.array(*[F.struct(F.length(b).alias("n"), F.lit(-k).alias("place"), b.alias("text")) for k, b in enumerate(bare)])
    return F.array_max(sized)["text"]
