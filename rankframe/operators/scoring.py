"""Scores of hits: hybrid of dense and BM25 with an adaptive weight, quality bonus, re-ranking and consolidation by page."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import text as T

#: Base weight of the dense score by type of query.
BASE_ALPHA = {"specific": 0.8, "concept": 0.6, "safety": 0.7, "dosing": 0.5, "general": 0.4, "complex": 0.6}
#: Section words and what a hit in such a section gains, the first that fits.
SECTION_BONUS = (("warning", 0.25), ("contraindication", 0.25), ("safety", 0.22), ("adverse", 0.2), ("reaction", 0.18), ("overdose", 0.18), ("dosage", 0.15), ("pediatric", 0.15), ("geriatric", 0.12))


def query_type(query: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """specific > safety > dosing > concept > complex (4 words, 2 terms) > general, by term patterns of each group."""
    n = {g: count_matches(query, p) for g, p in groups.items()}
    total = sum(n.values(), F.lit(0))
    none = F.lit(0)
    return (
        F.when(n.get("specific", none) > 0, "specific").when(n.get("safety", none) > 0, "safety").when(n.get("dosing", none) > 0, "dosing")
        .when(n.get("concept", none) > 0, "concept").when((F.size(T.words(query)) >= 4) & (total >= 2), "complex").otherwise("general")
    )


def count_matches(text: Column, patterns: Sequence[str]) -> Column:
    return sum((F.regexp_count(F.lower(text), F.lit(p)) for p in patterns), F.lit(0))


def adaptive_alpha(queries: DataFrame, groups: Mapping[str, Sequence[str]], text: str = "text") -> DataFrame:
    """Adds query_type, n_terms, base_alpha, adjustment, alpha and confidence.

    Two words or fewer +.1, six or more -.1; three terms or more +.15; a term of the group `cardiac` +.1; two of `safety`
    +.05; a question -.05. Confidence is .5 without an adjustment, else .5 + .1 for each up to .9, and .1 more where
    they sum to over .2 in size.
    """
    q = F.col(text)
    n_words = F.size(T.words(q))
    total = sum((count_matches(q, p) for p in groups.values()), F.lit(0))
    rules = [
        (n_words <= 2, 0.1), (n_words >= 6, -0.1), (total >= 3, 0.15), (count_matches(q, groups.get("cardiac", ())) > 0, 0.1),
        (count_matches(q, groups.get("safety", ())) >= 2, 0.05), (F.contains(q, F.lit("?")), -0.05),
    ]
    steps = F.array(*[F.when(c, F.lit(v)).otherwise(0.0) for c, v in rules])
    used = F.size(F.filter("steps", lambda x: x != 0))
    size = F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.abs(x))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE_ALPHA.items() for x in kv]), F.col("query_type"))
    out = queries.withColumn("query_type", query_type(q, groups)).withColumn("n_terms", total).withColumn("steps", steps).withColumn("base_alpha", base)
    out = out.withColumn("adjustment", F.aggregate("steps", F.lit(0.0), lambda s, x: s + x)).withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base_alpha") + F.col("adjustment"))))
    confidence = F.when(used == 0, 0.5).otherwise(F.least(F.lit(1.0), F.least(F.lit(0.9), 0.5 + 0.1 * used) + F.when(F.round(size, 9) > 0.2, 0.1).otherwise(0.0)))
    return out.withColumn("confidence", confidence).drop("steps")


def hybrid(hits: DataFrame) -> DataFrame:
    """Adds hybrid_score: alpha * score + (1 - alpha) * bm25_boost / 10 where the query has BM25 terms (bm25_terms > 0), else null."""
    value = F.col("alpha") * F.col("score") + (1 - F.col("alpha")) * F.col("bm25_boost") / 10
    return hits.withColumn("hybrid_score", F.when(F.col("bm25_terms") > 0, value))


def quality_bonus(hits: DataFrame, query_tokens: str = "query_tokens", text: str = "text", section: str = "section", sections: Sequence[tuple[str, float]] = SECTION_BONUS) -> DataFrame:
    """Adds quality_score (clamped to -.4 .. .85) and quality_factors by length, query coverage and section."""
    n = F.length(text)
    asked = F.size(query_tokens)
    found = T.let(F.lower(text), lambda low: F.size(F.filter(query_tokens, lambda t: F.contains(low, t))))
    length = F.when(n.between(400, 1200), 0.2).when(n < 200, -0.15).when(n > 1600, -0.1).otherwise(0.0)
    cover = F.when(asked == 0, 0.0).when(found > 0, F.least(F.lit(0.2), 0.25 * found / asked)).otherwise(-0.18)
    part, label = F.lit(0.0), F.lit(None).cast("string")
    for word, bonus in reversed(list(sections)):
        here = F.contains(F.lower(F.coalesce(section, F.lit(""))), F.lit(word))
        part, label = F.when(here, bonus).otherwise(part), F.when(here, f"section_{word}").otherwise(label)
    names = F.array(
        F.when(n.between(400, 1200), "ideal_length").when(n < 200, "too_short").when(n > 1600, "too_long"),
        F.when(asked == 0, None).when(found > 0, F.format_string("query_coverage_%d/%d", found, asked)).otherwise("no_query_terms"), label,
    )
    return hits.withColumn("quality_score", F.greatest(F.lit(-0.4), F.least(F.lit(0.85), length + cover + part))).withColumn("quality_factors", F.array_compact(names))


def quality_rescored(hits: DataFrame) -> DataFrame:
    """final_score: (hybrid, else dense score) * (1 + quality_score)."""
    return hits.withColumn("final_score", F.coalesce("hybrid_score", "score") * (1 + F.col("quality_score")))


def overlap_score(query_tokens: Column, text: Column) -> Column:
    """A deterministic pair score: the share of the query's distinct tokens that the text holds."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(text))) / F.size(q)).otherwise(0.0)


def pair_scorer(score: Callable[[list[str], list[str]], Sequence[float]]) -> Callable[[Column, Column], Column]:
    """A scorer of (query, text) columns from a function over lists of both: a model is called once for each Arrow batch. Nulls reach it as empty texts."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return run


def reranked(hits: DataFrame, score: Column, k: int, text: str = "text") -> DataFrame:
    """The k best hits of each query by another score; blank text is dropped, a null score falls back to the old one."""
    rows = hits.where(F.trim(text) != "").withColumn("rerank_score", F.coalesce(score, F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "doc_id")
    return rows.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)


def ensemble(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, ensemble_score): weighted sum of long (query_id, doc_id, scorer, score), equal weights by default."""
    if weights is None:
        weight = F.lit(1.0) / F.lit(scores.select("scorer").distinct().count())
    else:
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("scorer"))
    return scores.groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * weight).alias("ensemble_score"))


def consolidated(hits: DataFrame, most_hits: int = 15, budget: int = 25_000, by: Sequence[str] = ("source",)) -> DataFrame:
    """(query_id, the columns of `by`, n_chunks, avg_score, text) of the first hits by source, or by source and page, within a budget of characters by score."""
    groups = hits.where(F.col("rank") <= most_hits).groupBy("query_id", *by).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("score").alias("avg_score"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    groups = groups.withColumn("text", F.array_join(F.col("parts.text"), "\n\n")).drop("parts")
    running = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy(F.desc(F.round("avg_score", 9)), *by).rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("_chars", running).where(F.col("_chars") <= budget).drop("_chars")


def feedback_terms(hits: DataFrame, query_tokens: DataFrame, top_hits: int = 3, k: int = 5, stop: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """(query_id, term, n, rank): pseudo-relevance feedback, the frequent terms of the first hits that the query lacks."""
    terms = hits.where(F.col("rank") <= top_hits).select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(~F.col("term").isin(list(stop)))
    counts = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).join(query_tokens.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def concept_variants(query_tokens: DataFrame, concepts: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, synonym, rank): synonyms of the concepts (concept, synonym) that a query token names, in order, without its own tokens."""
    named = query_tokens.join(concepts.withColumnRenamed("synonym", "term"), "term").select("query_id", "concept").distinct()
    wide = named.join(concepts, "concept").select("query_id", F.col("synonym").alias("term")).distinct().join(query_tokens.select("query_id", "term"), ["query_id", "term"], "left_anti")
    return wide.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("term"))).where(F.col("rank") <= k).withColumnRenamed("term", "synonym")


def plain_words(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, whatever stands between them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def phrase_matches(queries: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, at, length, phrase): where a phrase's words stand one after another in (query_id, text), words counted from 0.

    A match inside a longer one doesn't count. Runs of up to as many words as the longest phrase has meet the phrases (phrase, its
    words joined by spaces) by an equi-join, so neither side visits all of the other. Repeated ids are one query with all their texts' matches.
    """
    most = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    runs = lambda w, n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("length"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("phrase")))
    empty = F.array().cast("array<struct<at:int,length:int,phrase:string>>")
    every = T.let(plain_words(F.col(text)), lambda w: F.concat(*[F.when(F.size(w) >= n, runs(w, n)).otherwise(empty) for n in range(1, most + 1)], empty))
    each = queries.select("query_id", F.explode(every).alias("r")).select("query_id", "r.*").join(phrases.distinct(), "phrase")
    held = each.groupBy("query_id").agg(F.collect_set(F.struct("at", "length", "phrase")).alias("m"))
    inside = lambda x, y: (y["length"] > x["length"]) & (y["at"] <= x["at"]) & (y["at"] + y["length"] >= x["at"] + x["length"])
    return held.select("query_id", F.explode(F.filter("m", lambda x: ~F.exists("m", lambda y: inside(x, y)))).alias("x")).select("query_id", "x.*")


def phrase_concepts(queries: DataFrame, concepts: DataFrame, k: int = 6, text: str = "text") -> DataFrame:
    """(query_id, synonym, rank): as concept_variants, with synonyms (concept, synonym) of one or more words, the longest that stands in
    the query winning; synonyms that stand anywhere in the query's text are left out."""
    rows = concepts.select("concept", F.array_join(plain_words(F.col("synonym")), " ").alias("phrase")).where("phrase <> ''").distinct()
    named = phrase_matches(queries, rows.select("phrase"), text).join(rows, "phrase").select("query_id", "concept").distinct()
    wide = named.join(rows, "concept").select("query_id", "phrase").distinct().join(queries.select("query_id", F.lower(text).alias("_t")), "query_id").where(~F.contains("_t", F.col("phrase")))
    ranked = wide.select("query_id", "phrase").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("phrase")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("phrase").alias("synonym"), "rank")


def first_variant(found: DataFrame) -> DataFrame:
    """One row per (query_id, doc_id) of hits of several query variants: that of the first variant (variant_ord) that found it."""
    rank = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("variant_ord", F.desc("score")))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r")


def intents(queries: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, intent, score, confidence, alternatives) from rules (intent, ord, pattern, weight): the sum of the weights that match.

    rules is a small table of parameters; ties go to the lower ord. Confidence is the top score's share of the best three, .5
    where nothing matches (then the last ord's intent, the general one).
    """
    pairs = queries.select("query_id", F.lower(text).alias("_q")).crossJoin(F.broadcast(rules))
    hit = F.when(F.regexp_count("_q", F.col("pattern")) > 0, F.col("weight")).otherwise(0.0)
    sums = pairs.groupBy("query_id", "intent", "ord").agg(F.sum(hit).alias("score"))
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).where("r <= 3")
    best = ranked.groupBy("query_id").agg(F.min(F.struct("r", "intent", "score")).alias("top"), F.sum("score").alias("three"), F.array_sort(F.collect_list(F.when((F.col("r") > 1) & (F.col("score") > 0), F.struct("r", "intent")))).alias("others"))
    return best.select("query_id", F.col("top.intent").alias("intent"), F.col("top.score").alias("score"), F.when(F.col("three") > 0, F.col("top.score") / F.col("three")).otherwise(0.5).alias("confidence"), F.array_join(F.col("others.intent"), ",").alias("alternatives"))
