"""Splitting documents: sections, sentence packing with overlap, paragraph packing, merging, and diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import lang
from rankframe.functions import text as T

TARGET, LEAST, MOST, OVERLAP = 500, 200, 750, 4


def is_header(line: Column, following: Column) -> Column:
    """Numbered; mostly capitals (10 characters or more); title case (3 words or more); or a bullet before a capital."""
    text = F.trim(line)
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    n_words, titled = F.size(T.words(text)), F.regexp_count(text, F.lit(r"(^|\s)[A-Z]"))
    caps = (F.length(text) >= 10) & (letters > 0) & (capitals >= 0.7 * letters) & ~F.coalesce(following, F.lit("")).rlike(r"^\s*[a-z]")
    title = (n_words >= 3) & (titled >= 0.6 * n_words) & (F.length(F.coalesce(following, F.lit(""))) < 100)
    bullet = text.rlike(r"^[-*•]\s*[A-Z]")
    return (text != "") & (F.length(text) <= 150) & (text.rlike(r"^\d") | caps | title | bullet)


def is_plain_header(line: Column, following: Column) -> Column:
    """The older rule: a number and then a letter, or capitals for three fifths of the letters (four characters or more)."""
    text = F.trim(line)
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    return (text != "") & (F.length(text) <= 150) & (text.rlike(r"^\d+(\.\d+)*\.?\s+[A-Za-z]") | ((F.length(text) >= 4) & (letters > 0) & (capitals >= 0.6 * letters)))


def sections(docs: DataFrame, text: str = "text", header: Callable[[Column, Column], Column] = is_header) -> DataFrame:
    """(doc_id, section_index, section_title, content): lines between headers; a section without content is dropped.

    Lines of one document are taken by array functions, so nothing shuffles; a section is a slice between two headers.
    """
    lines = docs.select("doc_id", F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    lines = lines.withColumn("lines", F.transform("lines", lambda x, i: F.struct(F.trim(x).alias("line"), F.coalesce(header(x, F.get("lines", i + 1)), F.lit(False)).alias("header"))))
    heads = F.concat(F.array(F.lit(-1)), F.filter(F.transform("lines", lambda x, i: F.when(x["header"], i)), lambda i: i.isNotNull()))

    def cut(starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            inside = F.slice("lines", at + 2, F.coalesce(F.get(starts, k + 1), F.size("lines")) - at - 1)
            parts = F.filter(F.transform(inside, lambda x: x["line"]), lambda x: x != "")
            return F.struct(F.when(at >= 0, F.get("lines", F.greatest(at, F.lit(0)))["line"]).otherwise("").alias("title"), parts.alias("parts"))

        return F.filter(F.transform(starts, one), lambda s: F.size(s["parts"]) > 0)

    found = lines.select("doc_id", F.posexplode(T.let(heads, cut)).alias("section_index", "s"))
    return found.select("doc_id", "section_index", F.col("s.title").alias("section_title"), F.array_join("s.parts", "\n").alias("content"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def packed(parts: Column, target: int = TARGET, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """array<struct<start,end,parts>>: sentences packed to chunks that repeat the last `overlap` sentences of the one before.

    A chunk closes before a sentence if the target would be passed and it has the least length, or if it has the most. The
    fold goes over the sentences' lengths and holds numbers only; a chunk is a slice. Lengths leave out the joining spaces.
    """
    first = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit(0).alias("i"))

    def bounds(lengths: Column) -> Column:
        def step(acc: Column, size: Column) -> Column:
            n = acc["i"] - acc["start"]
            close = ((n > 0) & (acc["len"] + size > target) & (acc["len"] >= least)) | (acc["len"] >= most)
            kept = F.least(n, F.lit(overlap))
            held = F.aggregate(F.slice(lengths, acc["i"] - kept + 1, kept), F.lit(0), lambda t, x: t + x)
            done = F.when(close, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("end")))).otherwise(acc["done"])
            return F.struct(done.alias("done"), (F.when(close, held).otherwise(acc["len"]) + size).alias("len"), F.when(close, acc["i"] - kept).otherwise(acc["start"]).alias("start"), (acc["i"] + 1).alias("i"))

        def finish(acc: Column) -> Column:
            last = F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("end"))
            return F.when(acc["i"] > acc["start"], F.array_append(acc["done"], last)).otherwise(acc["done"])

        return F.aggregate(lengths, first, step, finish)

    def sliced(ps: Column) -> Column:
        return F.transform(T.let(F.transform(ps, F.length), bounds), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.slice(ps, c["start"] + 1, c["end"] - c["start"] + 1).alias("parts")))

    return T.let(parts, sliced)


def chunks(docs: DataFrame, text: str = "text", target: int = TARGET, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, text, start_sentence_index, end_sentence_index, sentence_count, has_overlap, word_count, char_count, citation_id)."""
    found = docs.select("doc_id", F.posexplode(packed(sentences(T.normalised(F.coalesce(text, F.lit("")))), target, least, most, overlap)).alias("chunk_index", "c"))
    body = F.array_join("c.parts", " ")
    out = found.select("doc_id", "chunk_index", body.alias("text"), F.col("c.start").alias("start_sentence_index"), F.col("c.end").alias("end_sentence_index"))
    return out.select("*", F.greatest(F.lit(0), F.col("end_sentence_index") - F.col("start_sentence_index") + 1).alias("sentence_count"), (F.col("chunk_index") > 0).alias("has_overlap"), F.size(T.words(F.col("text"))).alias("word_count"), F.length("text").alias("char_count"), F.format_string("%d.%d", F.lit(1), F.col("chunk_index") + 1).alias("citation_id"))


def paragraphs_packed(parts: Column, size: Column, gap: str = "\n\n") -> Column:
    """array<string>: parts joined by the gap while what is joined and the next part stay within the size.

    The fold goes over lengths and holds numbers only; a joined text is a slice of the parts.
    """
    first = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit(0).alias("i"))

    def bounds(lengths: Column, most: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            flush = (acc["len"] + n > most) & (acc["len"] > 0)
            done = F.when(flush, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("end")))).otherwise(acc["done"])
            whole = F.when(flush | (acc["len"] == 0), n).otherwise(acc["len"] + len(gap) + n)
            return F.struct(done.alias("done"), whole.alias("len"), F.when(flush, acc["i"]).otherwise(acc["start"]).alias("start"), (acc["i"] + 1).alias("i"))

        last = lambda acc: F.array_append(acc["done"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("end")))
        return F.aggregate(lengths, first, step, lambda acc: F.when(acc["len"] > 0, last(acc)).otherwise(acc["done"]))

    def joined(ps: Column, most: Column) -> Column:
        return F.transform(T.let(F.transform(ps, F.length), lambda ls: bounds(ls, most)), lambda c: F.array_join(F.slice(ps, c["start"] + 1, c["end"] - c["start"] + 1), gap))

    return T.let(size, lambda most: T.let(parts, lambda ps: joined(F.filter(ps, lambda p: p != ""), most)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def simple_chunks(docs: DataFrame, text: str = "text", target: int = TARGET, short: int = 100) -> DataFrame:
    """(doc_id, chunk_index, text, mode): the plain splitter, for texts without headers.

    Paragraphs (mode paragraphs) are packed to a third of the text, 50 at least and `target` at most; a text of one paragraph is packed by
    sentences in the same way (sentences), and one under `short` characters is dealt to equal runs of sentences (runs), about half as
    many as it has. Null and blank texts give nothing.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.split(raw, "\n\n")
    rows = docs.select("doc_id", F.length(raw).alias("_n"), F.transform(paragraphs, stripped).alias("_p"), F.transform(F.split(raw, r"(?<=[.!?])\s+"), stripped).alias("_s"))
    rows = rows.withColumn("_single", (F.size("_p") == 1) | ((F.size("_p") == 2) & (F.get("_p", F.lit(1)) == ""))).withColumn("_runs", F.col("_single") & (F.col("_n") < short))
    size = F.least(F.lit(target), F.greatest(F.floor(F.col("_n") / 3).cast("int"), F.lit(50)))
    n = F.size("_s")
    per = F.greatest(F.lit(1), F.floor(n / F.least(n, F.greatest(F.lit(2), F.floor(n / 2).cast("int") + 1))).cast("int"))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(n / per).cast("int") - 1), lambda k: stripped(F.array_join(F.slice("_s", k * per + 1, per), " ")))
    made = F.when(F.col("_runs"), F.filter(runs, lambda t: t != "")).when(F.col("_single"), paragraphs_packed(F.col("_s"), size, " ")).otherwise(paragraphs_packed(F.col("_p"), size))
    mode = F.when(F.col("_runs"), "runs").when(F.col("_single"), "sentences").otherwise("paragraphs")
    return rows.select("doc_id", F.posexplode(made).alias("chunk_index", "text"), mode.alias("mode"))


def described(made: DataFrame, text: str = "text", section_title: Column | None = None, page: Column | None = None, domain: Sequence[str] = ()) -> DataFrame:
    """Adds what a chunk's record holds besides its text: language, page, section_title, section_code, keywords (the eight most frequent,
    ties by word), has_numeric_data, has_domain_patterns, text_density, normalized_text and citation_id. All of it is computed from the row."""
    title = F.lit("DOCUMENT_CONTENT") if section_title is None else section_title
    where = F.lit(1) if page is None else page
    t = F.col(text)
    ends = lambda ks: F.filter(F.transform(ks, lambda k, i: F.when(F.coalesce(F.get(ks, i + 1) != k, F.lit(True)), i)), lambda i: i.isNotNull())
    counted = lambda ks, es: F.sort_array(F.transform(es, lambda i, j: F.struct((F.coalesce(F.get(es, j - 1), F.lit(-1)) - i).alias("n"), F.get(ks, i).alias("token"))))
    words = F.sort_array(T.without(T.keyword_tokens(t), T.KEYWORD_STOP_WORDS))
    keywords = T.let(words, lambda ks: T.let(ends(ks), lambda es: F.transform(F.slice(counted(ks, es), 1, 8), lambda x: x["token"])))
    return made.withColumns({
        "language": lang.detect(t), "page": where, "section_title": title, "section_code": T.section_number(title), "keywords": keywords, "has_numeric_data": T.matches_any(t),
        "has_domain_patterns": T.matches_any(t, domain) if domain else F.lit(False), "text_density": T.density(t), "normalized_text": T.for_metadata(t), "citation_id": F.format_string("%d.%d", where, F.col("chunk_index") + 1),
    })


def merged(small: DataFrame, least: int = 550) -> DataFrame:
    """(doc_id, island, first_index, n_merged, text, char_count): chunks under the least size join the one before them."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    starts = (F.col("char_count") >= least) | (F.row_number().over(order) == 1)
    islands = small.withColumn("_s", starts.cast("int")).withColumn("island", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc_id", "island").agg(F.min("chunk_index").alias("first_index"), F.count(F.lit(1)).alias("n_merged"), F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    return out.select("doc_id", "island", "first_index", "n_merged", F.array_join("parts.text", "\n").alias("text")).withColumn("char_count", F.length("text"))


def coverage(docs: DataFrame, made: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_covered, coverage): sentences of the source that stand in some chunk."""
    wanted = docs.select("doc_id", F.explode(sentences(T.normalised(F.col(text)))).alias("sentence"))
    held = made.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    found = wanted.join(held, "doc_id", "left").withColumn("ok", F.coalesce(F.exists("texts", lambda t: F.contains(t, F.col("sentence"))), F.lit(False)))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.col("ok").cast("long")).alias("n_covered")).withColumn("coverage", F.col("n_covered") / F.col("n_sentences"))


def statistics(made: DataFrame, by: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, n_chunks, min_chars, max_chars, avg_chars, n_duplicates, n_duplicate_keys): a duplicate repeats the keys (such as page and
    section) and the first 80 characters; n_duplicate_keys counts the keys that stand more than once."""
    per = made.groupBy(by, *keys, F.left("text", F.lit(80)).alias("head")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"), F.sum(F.length("text")).alias("chars"))
    return per.groupBy(by).agg(F.sum("n").alias("n_chunks"), F.min("lo").alias("min_chars"), F.max("hi").alias("max_chars"), (F.sum("chars") / F.sum("n")).alias("avg_chars"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum((F.col("n") > 1).cast("long")).alias("n_duplicate_keys"))


def windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<start,end>> (characters from 0): windows of a size that end at the last sentence end of their final fifth, else
    at the last white space of their second half, else at the size; the next begins `overlap` before, always further on."""
    n = F.length(text)
    least = max(1, size // 2 - overlap)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(n / least).cast("int"), F.lit(1)))
    pair = "array<struct<start:int,end:int>>"
    first = F.struct(F.array().cast(pair).alias("done"), F.lit(0).alias("start"))

    def step(acc: Column, _: Column) -> Column:
        start = acc["start"]
        near, far = size - size // 5, size // 2
        sentence = F.length(F.regexp_extract(F.substring(text, start + near + 1, F.lit(size - near)), r"(?s)^(.*[.!?])\s", 1))
        word = F.length(F.regexp_extract(F.substring(text, start + far + 1, F.lit(size - far)), r"(?s)^(.*)\s", 1))
        end = F.when(start + size >= n, n).when(sentence > 0, start + near + sentence).when(word > 0, start + far + word).otherwise(start + size)
        over = (start >= n) | (n == 0)
        done = F.when(over, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(done.alias("done"), F.when(over | (end >= n), n).otherwise(F.greatest(end - overlap, start + 1)).alias("start"))

    return F.aggregate(steps, first, step, lambda acc: acc["done"])


def windowed(docs: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start, end, text) of `windows`; null and empty texts have none."""
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("_t"))
    found = rows.select("doc_id", "_t", F.posexplode(windows(F.col("_t"), size, overlap)).alias("chunk_index", "w"))
    return found.select("doc_id", "chunk_index", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.substring("_t", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"))


def paragraphs_overlapped(parts: Column, size: int = 1000, overlap_words: int = 3, least: int = 100) -> Column:
    """array<string>: parts packed to a size, each after the first led by the last words of the one before; the last joins the one
    before where it is under the least size."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    blank = F.lit("\n\n")

    def step(acc: Column, p: Column) -> Column:
        flush = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) + 2 > size)
        w = T.words(acc["cur"])
        lead = F.array_join(F.slice(w, F.greatest(F.size(w) - overlap_words + 1, F.lit(1)), F.lit(overlap_words)), " ")
        done = F.when(flush, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
        cur = F.when(flush, F.concat(lead, F.lit(" "), p)).when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], blank, p))
        return F.struct(done.alias("done"), cur.alias("cur"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        short = (n > 0) & (F.length(acc["cur"]) < least)
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(acc["done"], n - 1), blank, acc["cur"])))
        return F.when(acc["cur"] == "", acc["done"]).when(short, joined).otherwise(F.array_append(acc["done"], acc["cur"]))

    return F.aggregate(parts, first, step, finish)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n+"), lambda x: F.trim(x)), lambda x: x != "")


def dispatched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, mode, section_title, text): texts over 500 characters by section, unless they are one section of
    over 750; those and short texts by paragraphs (lines). Each document takes one way, and its chunks are numbered anew."""
    rows = docs.select("doc_id", T.normalised(F.coalesce(text, F.lit(""))).alias("text"))
    cut = sections(rows.where(F.length("text") > 500))
    held = Window.partitionBy("doc_id")
    cut = cut.withColumn("_n", F.count(F.lit(1)).over(held)).withColumn("_one", (F.col("_n") == 1) & (F.length("content") > 750))
    by_section = cut.where("not _one").select("doc_id", "section_index", "section_title", F.posexplode(packed(sentences(F.col("content")))).alias("i", "c"))
    by_section = by_section.select("doc_id", F.lit("section").alias("mode"), "section_title", "section_index", "i", F.array_join("c.parts", " ").alias("text"))
    whole = rows.join(cut.where("not _one").select("doc_id").distinct(), "doc_id", "left_anti")
    size = F.least(F.lit(500), F.greatest(F.floor(F.length("text") / 3), F.lit(50)))
    simple = whole.select("doc_id", F.posexplode(paragraphs_packed(lines_of(F.col("text")), size)).alias("i", "text"))
    simple = simple.select("doc_id", F.lit("simple").alias("mode"), F.lit("").alias("section_title"), F.lit(0).alias("section_index"), "i", "text")
    both = by_section.unionByName(simple)
    return both.withColumn("chunk_index", F.row_number().over(held.orderBy("section_index", "i")) - 1).select("doc_id", "chunk_index", "mode", "section_title", "text")
