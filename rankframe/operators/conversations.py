"""Conversations and citations: sessions, history, analytics, references of answers, and the document catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.sources.scratch import written


def sessions(messages: DataFrame, pages: DataFrame | None, key: str, at: str, query: str, limit: int | None = 50) -> DataFrame:
    """(key, last_activity, n_messages, title): newest first. The title is the page's where the first message (the least in
    order of text) is over 50 characters, else that message."""
    per = messages.groupBy(key).agg(F.max(at).alias("last_activity"), F.count(F.lit(1)).alias("n_messages"), F.min(query).alias("first"))
    if pages is not None:
        per = per.join(pages.select(key, "page_title"), key, "left")
    title = F.when(F.length("first") > 50, F.coalesce("page_title" if pages is not None else F.lit(None), F.concat(F.left("first", F.lit(50)), F.lit("...")))).otherwise(F.col("first"))
    out = per.select(key, "last_activity", "n_messages", title.alias("title")).orderBy(F.desc("last_activity"), key)
    return out.limit(limit) if limit else out


def turns_paired(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, user_query, assistant_response): each user turn with the turn after it."""
    after = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_response"))
    return messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query")).join(after, ["conv_id", "turn"])


def searched(messages: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Messages in which any of the columns holds the words, whatever their case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(needle.lower()))
    return messages.where(F.coalesce(hit, F.lit(False)))


def upserted(registrations: DataFrame, key: str, at: str, keep_first: tuple[str, ...], keep_last: tuple[str, ...]) -> DataFrame:
    """One row per key: the first title and time of registration, the last of the other columns."""
    return registrations.groupBy(key).agg(*[F.min_by(c, F.struct(at, c)).alias(c) for c in keep_first], *[F.max_by(c, F.struct(at, c)).alias(c) for c in keep_last], F.min(at).alias("registered_at"), F.max(at).alias("updated_at"))


def collision_safe(names: DataFrame, name: str, order: tuple[str, ...]) -> DataFrame:
    """Adds object_name: name, then name_1, name_2 before the extension, distinct over all rows; a null name has none.

    Rows of one name are numbered in order. A name that comes out twice, since a row is called so or two families meet, stays with
    the row that is called so, else with the first in order; the others take numbers behind their family's last one, until no name is
    taken twice. Each round moves whole families at once and names by an anti-join, so rounds are few: as many as collisions in a chain.
    """
    parts = r"^(.*?)(\.[^.]*)?$"
    rows = names.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1)
    call = F.when(F.col("_n") > 0, F.concat(F.regexp_extract(name, parts, 1), F.lit("_"), F.col("_n"), F.regexp_extract(name, parts, 2))).otherwise(F.col(name))
    done, open_ = None, written(rows.withColumn("object_name", call), "names")
    while True:
        turn = Window.partitionBy("object_name").orderBy(F.col("_n") > 0, *order, "_n")
        placed = open_.withColumn("_turn", F.when(F.col("object_name").isNull(), 1).otherwise(F.row_number().over(turn)))
        if done is not None:
            taken = done.select("object_name", F.lit(True).alias("_taken")).distinct()
            placed = placed.join(taken, "object_name", "left").withColumn("_turn", F.when(F.col("_taken"), 2).otherwise(F.col("_turn"))).drop("_taken")
        placed = written(placed, "placed-names")
        won = placed.where("_turn = 1").drop("_turn")
        done = won if done is None else written(done.unionByName(won), "names")
        lost = placed.where("_turn > 1").drop("_turn")
        if lost.isEmpty():
            return done.drop("_n")
        last = done.select(name, "_n").unionByName(placed.select(name, "_n")).groupBy(name).agg(F.max("_n").alias("_last"))
        lost = lost.join(last, name).withColumn("_n", F.col("_last") + F.row_number().over(Window.partitionBy(name).orderBy("_n"))).drop("_last")
        open_ = written(lost.withColumn("object_name", call).select(*placed.drop("_turn").columns), "names")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones of keys that the new ones lack; blank texts are left out."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new).where(F.trim("text") != "")


def numbered(chunks: DataFrame, most: int = 5) -> DataFrame:
    """Adds doc_num and pos to (answer_id, category_ord, rank, source): the first `most` of each category; documents are numbered
    across categories by first appearance, chunks within their document."""
    rows = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("answer_id", "category_ord").orderBy("rank"))).where(F.col("_r") <= most)
    rows = rows.withColumn("_f", F.min(F.struct("category_ord", "rank")).over(Window.partitionBy("answer_id", "source")))
    rows = rows.withColumn("doc_num", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("_f")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("answer_id", "doc_num").orderBy("category_ord", "rank"))).drop("_r", "_f")


def references(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, doc_num, pos, display_pos, source): cited chunks only, numbered within a document by first use in the answer."""
    cited = answers.select("answer_id", F.posexplode(T.citations(F.col("text"))).alias("ord", "c")).select("answer_id", "ord", "c.doc_num", "c.pos")
    found = cited.join(chunks.select("answer_id", "doc_num", "pos", "source"), ["answer_id", "doc_num", "pos"])
    return found.withColumn("display_pos", F.row_number().over(Window.partitionBy("answer_id", "doc_num").orderBy("ord"))).drop("ord")


def orphans(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, doc_num, pos): citations of chunks that aren't there."""
    cited = answers.select("answer_id", F.explode(T.citations(F.col("text"))).alias("c")).select("answer_id", "c.doc_num", "c.pos")
    return cited.join(chunks.select("answer_id", "doc_num", "pos"), ["answer_id", "doc_num", "pos"], "left_anti")


def segments(answers: DataFrame, text: str = "text") -> DataFrame:
    """(key, index, total, word, is_citation): answers as running words."""
    w = T.words(F.col(text))
    rows = answers.select("answer_id", F.size(w).alias("total"), F.posexplode(w).alias("index", "word"))
    return rows.withColumn("is_citation", F.col("word").rlike(r"^\[\d+\.\d+\]"))


def fill_counts(rows: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """(by, field, n_filled, n_distinct) of each column."""
    text = rows.select(by, *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([by], list(columns), "field", "value")
    return long.groupBy(by, "field").agg(F.count(F.nullif("value", F.lit(""))).alias("n_filled"), F.count_distinct("value").alias("n_distinct"))


def first_passage(rows: DataFrame, key: str, text: Column, order: tuple[str, ...], least: int = 20) -> DataFrame:
    """The first row for each key and text, whatever its case and spaces, of at least `least` characters."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    groups = rows.withColumn("_t", flat).where(F.length("_t") >= least).groupBy(F.col(key).alias("_k"), F.sha2("_t", 256).alias("_h"))
    first = groups.agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def history(messages: DataFrame, at: str, limit: int = 50, **equal: object) -> DataFrame:
    """The messages newest first, of the given users, sessions or pages only (column=value), up to a limit."""
    for c, v in equal.items():
        messages = messages.where(F.col(c) == F.lit(v))
    return messages.orderBy(F.desc(at), *[c for c in messages.columns if c != at]).limit(limit)


def latest_each(messages: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The last messages of every key at once, numbered from the newest."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("place") <= most)


def listing(pages: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Each page with its number of messages, 0 where it has none."""
    counts = messages.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"))
    return pages.join(counts, key, "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


#: The source of an answer's first and second paragraph, of any other, and words that tell it better, the first that fits.
PARAGRAPH_SOURCES = ("PIS", "LRD", "OTHER")
SOURCE_WORDS = (("PIS", ("no source 1", "no pi document")), ("LRD", ("no source 2", "no lrd document")), ("OTHER", ("no source 3", "past cases")))


def tokens(answers: DataFrame, text: str = "text", key: str = "answer_id") -> DataFrame:
    """(key, paragraph, source_type, index, total_tokens, token, is_citation): answers as they are given out, word by word.

    Paragraphs stand between blank lines, also escaped ones; blank ones don't count. A word behind the first of its paragraph brings its
    space. index runs through the whole answer. A null or blank answer gives nothing.
    """
    whole = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n\\n"), F.lit("\n\n")), F.lit("\\n"), F.lit("\n"))
    paragraphs = F.filter(F.transform(F.split(whole, "\n\n"), lambda p: T.words(p)), lambda w: F.size(w) > 0)
    rows = answers.select(key, paragraphs.alias("_p"))
    before = lambda i: F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda n, w: n + F.size(w))
    each = rows.select(key, F.aggregate("_p", F.lit(0), lambda n, w: n + F.size(w)).alias("total_tokens"), F.posexplode(F.transform("_p", lambda w, i: F.struct(w.alias("w"), before(i).alias("first")))).alias("paragraph", "x"))
    low = F.lower(F.array_join("x.w", " "))
    first, second, other = PARAGRAPH_SOURCES
    source = F.when(F.col("paragraph") == 0, first).when(F.col("paragraph") == 1, second).otherwise(other)
    for name, words in reversed(SOURCE_WORDS):
        source = F.when(T.holds_any(low, words), name).otherwise(source)
    found = each.select(key, "total_tokens", "paragraph", source.alias("source_type"), F.col("x.first").alias("_first"), F.posexplode("x.w").alias("_i", "_w"))
    token = F.when(F.col("_i") > 0, F.concat(F.lit(" "), F.col("_w"))).otherwise(F.col("_w"))
    return found.select(key, "paragraph", "source_type", (F.col("_first") + F.col("_i")).alias("index"), "total_tokens", token.alias("token"), token.rlike(r"\[\d+\.\d+\]").alias("is_citation"))
