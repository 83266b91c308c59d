"""Where a cited passage stands in a document: word for word, in a window of sentences, by its beginning or by its middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators.chunking import sentences

MOST_SEGMENTS = 20
FULL, PARTIAL, LENGTH_SHARE = 0.8, 0.7, 0.7
#: How like the text behind a found beginning, and around a found middle, must be; least sizes of both, and characters around the middle.
HEAD_LIKE, MIDDLE_LIKE, LEAST_HEAD, LEAST_MIDDLE, AROUND = 0.6, 0.5, 30, 20, 100


def flat(text: Column) -> Column:
    """Lower case, hyphenated line ends joined, single spaces."""
    return F.lower(T.for_metadata(F.coalesce(text, F.lit(""))))


def grounded(pairs: DataFrame, text: str = "text", passage: str = "passage") -> DataFrame:
    """Adds match_type (exact, full, partial, prefix, middle or none), similarity and match_start to rows of a text and a passage.

    exact: the passage stands in the text but for case and white space. full, partial: a run of as many sentences as the
    passage has (20 at most) is more than .8, or more than .7 at .7 of the length or more, like it. prefix: the longest run
    of its first words, over half of them and 30 characters at least, where the text from there on, as long as the passage, is more
    than .6 like it. middle: its middle half, for passages of 50 characters or more, where it and 100 characters on both sides are
    more than .5 like the passage. match_start counts characters of the flat text from 0, null for full, partial and none. A blank
    passage has none. The windows grow with the text's sentences, each window with the passage.
    """
    rows = pairs.withColumn("_t", flat(F.col(text))).withColumn("_p", flat(F.col(passage)))
    rows = rows.withColumn("_exact", F.instr("_t", F.col("_p")) - 1).withColumn("_miss", (F.col("_exact") < 0) & (F.col("_p") != ""))
    parts = F.when(F.col("_miss"), sentences(F.col("_t"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_s", parts).withColumn("_m", F.least(F.greatest(F.size(sentences(F.col("_p"))), F.lit(1)), F.lit(MOST_SEGMENTS)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_s") - F.col("_m") + 1, F.lit(1)))
    near = F.transform(starts, lambda i: F.array_join(F.slice("_s", i, F.col("_m")), " "))
    scored = F.transform(near, lambda w: F.struct(T.blended_similarity(w, F.col("_p")).alias("similarity"), F.length(w).alias("n")))
    rows = rows.withColumn("_best", F.when(F.col("_miss"), F.array_max(scored)))
    n, w = F.length("_p"), F.split("_p", " ")
    half = F.greatest(F.floor(F.size(w) / 2), F.lit(4)).cast("int") + 1
    sizes = F.when(F.col("_miss") & (F.size(w) >= half), F.sequence(F.size(w), half, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    heads = F.filter(F.transform(sizes, lambda n: F.array_join(F.slice(w, F.lit(1), n), " ")), lambda h: (F.length(h) >= LEAST_HEAD) & F.contains("_t", h))
    placed = F.transform(heads, lambda h: F.struct((F.instr(F.col("_t"), h) - 1).alias("at"), T.blended_similarity(F.col("_p"), F.substring("_t", F.instr(F.col("_t"), h), n)).alias("like")))
    rows = rows.withColumn("_head", F.get(F.filter(placed, lambda x: x["like"] > HEAD_LIKE), F.lit(0)))
    size = F.greatest(F.lit(LEAST_HEAD), F.floor(n / 2).cast("int"))
    middle = F.when(F.col("_miss") & (n >= 50), F.substring("_p", F.floor(n / 4).cast("int") + 1, size))
    rows = rows.withColumn("_middle", F.when((F.length(F.trim(middle)) >= LEAST_MIDDLE) & F.contains("_t", middle), middle))
    at = F.instr("_t", F.col("_middle")) - 1
    first = F.greatest(F.lit(0), at - AROUND)
    around = F.substring("_t", first + 1, at + F.length("_middle") + AROUND - first)
    rows = rows.withColumn("_around", F.when(F.col("_middle").isNotNull(), T.blended_similarity(F.col("_p"), around)))
    like, long = F.col("_best.similarity"), F.col("_best.n")
    kind = (
        F.when(F.col("_p") == "", "none").when(F.col("_exact") >= 0, "exact").when(like > FULL, "full").when((like > PARTIAL) & (long >= LENGTH_SHARE * n), "partial")
        .when(F.col("_head").isNotNull(), "prefix").when(F.col("_around") > MIDDLE_LIKE, "middle").otherwise("none")
    )
    rows = rows.withColumn("match_type", kind)
    at = F.when(F.col("match_type") == "exact", F.col("_exact")).when(F.col("match_type") == "prefix", F.col("_head.at")).when(F.col("match_type") == "middle", F.instr("_t", F.col("_middle")) - 1)
    alike = F.when(F.col("match_type") == "exact", 1.0).when(F.col("match_type") == "none", 0.0).when(F.col("match_type") == "prefix", F.col("_head.like")).when(F.col("match_type") == "middle", F.col("_around")).otherwise(like)
    return rows.withColumn("similarity", alike).withColumn("match_start", at).drop("_t", "_p", "_exact", "_miss", "_s", "_m", "_best", "_head", "_middle", "_around")
