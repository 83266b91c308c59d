"""Composed search: several variants of each query, dense and BM25 hits together, scored, boosted and cut."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import bm25, dense
from rankframe.operators import scoring as S
from rankframe.sources.scratch import written

#: What to fetch for an intent: number of hits, whether the query is expanded, and the sections that come first.
STRATEGIES = (("safety", 15, True, "warnings,adverse"), ("dosing", 8, False, "dosage"), ("pediatric", 12, True, "pediatric"), ("monitoring", 10, True, "monitoring"), ("contraindication", 8, True, "contraindications"))
DEFAULT_STRATEGY = (10, True, "")


def corpus_terms(text: Column, phrases: Sequence[str], triggers: Sequence[str]) -> Column:
    """The distinct phrases of a text that a pattern finds, and trigger words with the word after them, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    w = T.words(low)
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(a.isin(list(triggers)) & b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in phrases], F.array_compact(pairs)))


def term_corpus(docs: DataFrame, phrases: Sequence[str], triggers: Sequence[str]) -> DataFrame:
    """(term, n_docs): how many documents have each of their corpus_terms."""
    return docs.select(F.explode(corpus_terms(F.col("text"), phrases, triggers)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def variants(queries: DataFrame, extra: DataFrame) -> DataFrame:
    """(query_id, ord, text): each query as it is (0), and with each extra term (query_id, term, ord) appended; variants equal but for case stand once."""
    plain = queries.select("query_id", F.lit(0).alias("ord"), "text")
    more = queries.select("query_id", "text").join(extra, "query_id").select("query_id", F.col("ord").cast("int").alias("ord"), F.concat_ws(" ", "text", "term").alias("text"))
    return plain.unionByName(more).groupBy("query_id", F.lower("text").alias("_l")).agg(F.min_by(F.struct("ord", "text"), "ord").alias("v")).select("query_id", "v.ord", "v.text")


def multi_query(docs: DataFrame, queries: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, variant_ord): BM25 hits of all variants in one pass, each document by the first variant that found it."""
    return _first_hits(docs, written(variants(queries, extra), "variants"), k)


def _first_hits(docs: DataFrame, asked: DataFrame, k: int, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    each = asked.select(F.struct("query_id", "ord").alias("query_id"), "text")
    hits = bm25.search(docs, each, k, index=index, stats=stats).select(F.col("query_id.query_id").alias("query_id"), "doc_id", "score", F.col("query_id.ord").alias("variant_ord"))
    return S.first_variant(hits)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, extra: DataFrame, groups: Mapping[str, Sequence[str]], k: int, pool: int, section: str, sections: Sequence[tuple[str, float]]) -> DataFrame:
    """(query_id, doc_id, variant_ord, score, bm25_boost, alpha, hybrid_score, quality_score, final_score, rank).

    docs: (doc_id, text, section), vectors: (doc_id, embedding) of some of them, queries: (query_id, text, embedding). The pool is the dense hits (variant -1)
    and those of the variants; a document or query without a vector has a dense score of 0. Each hit's dense score is then
    blended with what its query's terms weigh in it, raised by its quality and cut to k. The variants and one index of
    their terms are written once and serve both the hits and the weights.
    """
    every = written(variants(queries, extra), "variants")
    index, stats = bm25.indexed(docs, bm25.query_terms(every).select("term").distinct())
    near = dense.nearest(vectors.join(docs.select("doc_id"), "doc_id", "left_semi"), queries, pool).select("query_id", "doc_id", "score", F.lit(-1).alias("variant_ord"))
    found = S.first_variant(near.unionByName(_first_hits(docs, every, pool, index, stats))).select("query_id", "doc_id", "variant_ord")
    asked = S.adaptive_alpha(queries, groups).select("query_id", "alpha", F.col("embedding").alias("_q"), T.without(T.tokens(F.col("text"))).alias("query_tokens"))
    hits = found.join(docs.select("doc_id", "text", section), "doc_id").join(vectors.select("doc_id", F.col("embedding").alias("_d")), "doc_id", "left").join(asked, "query_id")
    hits = hits.withColumn("score", F.coalesce(dense.cosine(F.col("_q"), F.col("_d")), F.lit(0.0))).drop("_q", "_d")
    terms = bm25.query_terms(queries)
    weights = bm25.idf(index, stats, terms.select("term").distinct()).where("idf > 0")
    scored = terms.join(weights, "term").select("query_id", "term", F.col("idf").alias("score"))
    counts = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("bm25_terms"))
    hits = bm25.term_boost(hits, scored).join(counts, "query_id", "left").withColumn("bm25_terms", F.coalesce("bm25_terms", F.lit(0)))
    rated = S.quality_rescored(S.quality_bonus(S.hybrid(hits), section=section, sections=sections))
    return bm25.top_k(rated, k, "final_score").select("query_id", "doc_id", "variant_ord", "score", "bm25_boost", "alpha", "hybrid_score", "quality_score", "final_score", "rank")


def envelope(hits: DataFrame, kind: str) -> DataFrame:
    """(query_id, kind, total, sources): what a search by kind returns around its hits, sources sorted and distinct."""
    return hits.groupBy("query_id", kind).agg(F.count(F.lit(1)).alias("total"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def strategies(intents: DataFrame, rows: Sequence[tuple[str, int, bool, str]] = STRATEGIES, default: tuple[int, bool, str] = DEFAULT_STRATEGY) -> DataFrame:
    """Adds top_k, expand_query and sections to (query_id, intent): those of its row, else the default."""
    out = {"top_k": default[0], "expand_query": default[1], "sections": default[2]}
    for i, name in enumerate(out, 1):
        value = F.lit(out[name])
        for row in rows:
            value = F.when(F.col("intent") == row[0], F.lit(row[i])).otherwise(value)
        intents = intents.withColumn(name, value)
    return intents


def alpha_reasons(rated: DataFrame) -> DataFrame:
    """Adds reasoning to the rows of adaptive_alpha: type, base, sum of adjustments and the weight in words."""
    words = F.when(F.col("alpha") >= 0.7, "dense first").when(F.col("alpha") <= 0.4, "terms first").otherwise("balanced")
    return rated.withColumn("reasoning", F.concat_ws(" | ", F.concat(F.lit("type "), F.col("query_type")), F.format_string("base %.2f", "base_alpha"), F.format_string("adjusted %+.2f", F.round("adjustment", 6)), words))


def domain_boost(hits: DataFrame, query: str, text: str, section: str, groups: Mapping[str, str], each: float = 0.2, most: float = 0.5) -> DataFrame:
    """Adds domain_boost and boosted_score: `each` for every category whose pattern stands in the query and in the text or section."""
    total = F.lit(0.0)
    for pattern in groups.values():
        there = F.coalesce(F.lower(query).rlike(pattern) & (F.lower(text).rlike(pattern) | F.lower(F.coalesce(section, F.lit(""))).rlike(pattern)), F.lit(False))
        total = total + F.when(there, each).otherwise(0.0)
    return hits.withColumn("domain_boost", F.least(total, F.lit(most))).withColumn("boosted_score", F.col("score") * (1 + F.col("domain_boost")))


def projected(hits: DataFrame, most_hits: int = 20, most_chars: int = 1500) -> DataFrame:
    """The first hits in the shape of an answer: source and section by their first filled name, text cut, region of own history marked."""
    have = set(hits.columns)
    pick = lambda *names, default: T.first_filled(*[F.col(n).cast("string") for n in names if n in have], default=default)
    return hits.where(F.col("rank") <= most_hits).select(
        "query_id", "doc_id", "rank", pick("source", "document", "file_name", default="unknown").alias("source"), pick("section_title", "section", "chunk_type", default="").alias("section"),
        F.left("text", F.lit(most_chars)).alias("text"), F.when(pick("document_type", default="") == "past_cases", "user_history").otherwise(pick("region", "country", "lang", default="")).alias("region"),
    )
