"""Search in stages: filters that are relaxed only for the queries they leave empty, and variants only where they are called for.

Every stage is one job over all queries that it concerns, found by an anti-join with what the stages before have found: a
query that has its hits takes no part in the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import bm25, dense
from rankframe.operators import scoring as S
from rankframe.sources.scratch import written

#: Filters: columns of documents, and of queries as lists of the values that they take.
FILTERS = ("document_type", "region", "user_id")
#: Types whose filter is never dropped.
FIXED_TYPES = ("pis", "lrd", "hpl", "past_cases")
#: Places of the variants of a query by where their terms come from.
CONCEPT, FEEDBACK, TERMS = 1, 101, 201


def base_hits(docs: DataFrame, queries: DataFrame, k: int, fixed: Sequence[str] = FIXED_TYPES) -> DataFrame:
    """(query_id, doc_id, score, rank, level): dense hits under all filters (level 0); of queries without any, those without the region
    filter (1); of those still without any, those with the region but without the type filter (2), unless the type is a fixed one.

    queries: (query_id, embedding, kind, and a list for each of FILTERS, null for any).
    """

    def stage(asked: DataFrame, level: int) -> DataFrame:
        return written(dense.nearest(docs, asked, k, filters=FILTERS).withColumn("level", F.lit(level)), f"level-{level}")

    anything = F.lit(None).cast("array<string>")
    first = stage(queries, 0)
    without = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = stage(without.where("region is not null").withColumn("region", anything), 1)
    without = without.join(second.select("query_id").distinct(), "query_id", "left_anti")
    droppable = F.col("document_type").isNotNull() & ~F.coalesce(F.col("kind").isin(list(fixed)), F.lit(False))
    third = stage(without.where(droppable).withColumn("document_type", anything), 2)
    return first.unionByName(second).unionByName(third)


def active_filters(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """queries with level and n_base, their filters as the level leaves them, and `short`: fewer hits than three and than half of k."""
    per = base.groupBy("query_id").agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("n_base"))
    out = queries.join(per, "query_id", "left").withColumns({"level": F.coalesce("level", F.lit(0)), "n_base": F.coalesce("n_base", F.lit(0).cast("long"))})
    anything = F.lit(None).cast("array<string>")
    out = out.withColumns({"region": F.when(F.col("level") == 1, anything).otherwise(F.col("region")), "document_type": F.when(F.col("level") == 2, anything).otherwise(F.col("document_type"))})
    return out.withColumn("short", F.col("n_base") < max(3, k // 2))


def query_variants(queries: DataFrame, concepts: DataFrame, feedback: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, ord, source, text): the query with each term (query_id, term, rank) behind it, concepts first, then feedback, then terms.

    Variants that equal the query or an earlier one but for case are left out.
    """
    named = ((concepts, CONCEPT, "concept"), (feedback, FEEDBACK, "prf"), (terms, TERMS, "bm25"))
    rows = queries.select("query_id", F.lit(0).alias("ord"), F.lit("base").alias("source"), F.lit("").alias("term"))
    for frame, first, source in named:
        rows = rows.unionByName(frame.select("query_id", (F.col("rank") + first - 1).cast("int").alias("ord"), F.lit(source).alias("source"), "term"))
    texts = rows.join(queries.select("query_id", "text"), "query_id").withColumn("text", F.trim(F.concat_ws(" ", "text", "term")))
    one = texts.groupBy("query_id", F.lower("text").alias("_l")).agg(F.min_by(F.struct("ord", "source", "text"), "ord").alias("v"))
    return one.select("query_id", "v.*")


def search(docs: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], corpus: DataFrame, concepts: DataFrame, groups: Mapping[str, Sequence[str]], k: int, sections: Sequence[tuple[str, float]], section: str = "section") -> tuple[DataFrame, DataFrame]:
    """Hits and metadata of the whole search.

    docs: (doc_id, text, embedding, a column for each of FILTERS, section). queries: (query_id, text, embedding, kind, a list for each of
    FILTERS). corpus: (term); concepts: (query_id, term, rank).

    Dense hits go down the filters (base_hits). Variants are built of concepts, of the frequent terms of the first hits, and, for the
    queries with too few hits, of the five phrases of the term corpus with the best BM25 score; they are embedded, and searched under
    the filters that gave the query its hits. A document counts by the first variant that found it. Its dense score is blended with the
    scores of the query's phrases that stand in it, raised by quality and cut to k.

    hits: (query_id, doc_id, ord, score, bm25_boost, hybrid_score, quality_score, final_score, rank). metadata, one row for each query:
    (query_id, level, fallback_region, fallback_type, n_base, short, alpha, concepts, prf_terms, bm25_terms, n_scored_terms, variants),
    variants being (ord, source, text, n_hits) in order. A query without hits has its row there too.
    """
    asked = written(S.adaptive_alpha(queries, groups), "asked")
    vectors = written(docs.select("doc_id", "embedding", *FILTERS), "vectors")  # embedded once for all stages
    corpus = written(corpus.select("term"), "corpus")
    base = base_hits(vectors, asked, k)
    active = written(active_filters(asked, base, k), "active")
    scored = written(bm25.pairs(corpus.select(F.col("term").alias("doc_id"), F.col("term").alias("text")), asked.select("query_id", "text")).withColumnRenamed("doc_id", "term"), "phrases")
    best = scored.join(active.where("short").select("query_id"), "query_id", "left_semi")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "term"))).where("rank <= 5")
    texts = docs.select("doc_id", "text", section)
    feedback = S.feedback_terms(base.where("rank <= 3").join(texts, "doc_id"), bm25.query_terms(asked))
    every = written(query_variants(asked, concepts, feedback, best), "variants")
    more = every.where("ord > 0").join(active.select("query_id", *FILTERS), "query_id").withColumn("embedding", embed(F.col("text")))
    more = written(more.select(F.struct("query_id", "ord").alias("query_id"), "embedding", *FILTERS), "more")
    found = dense.nearest(vectors, more, k, filters=FILTERS)
    found = base.select("query_id", F.lit(0).alias("ord"), "doc_id", "score").unionByName(found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.ord").alias("ord"), "doc_id", "score"))
    found = written(found, "found")

    hits = S.first_variant(found.withColumnRenamed("ord", "variant_ord")).withColumnRenamed("variant_ord", "ord").join(texts, "doc_id")
    counts = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("bm25_terms"))
    hits = hits.join(asked.select("query_id", "alpha", T.without(T.tokens(F.col("text"))).alias("query_tokens")), "query_id")
    hits = bm25.phrase_boost(hits, scored).join(counts, "query_id", "left").withColumn("bm25_terms", F.coalesce("bm25_terms", F.lit(0)))
    rated = bm25.top_k(S.quality_rescored(S.quality_bonus(S.hybrid(hits), section=section, sections=sections)), k, "final_score")

    ran = every.join(found.groupBy("query_id", "ord").agg(F.count(F.lit(1)).alias("n_hits")), ["query_id", "ord"], "left")
    ran = ran.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "text", F.coalesce("n_hits", F.lit(0)).alias("n_hits")))).alias("variants"))
    listed = lambda frame, name: frame.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias(name))
    meta = active.select("query_id", "level", (F.col("level") == 1).alias("fallback_region"), (F.col("level") == 2).alias("fallback_type"), "n_base", "short", "alpha").join(ran, "query_id", "left")
    for frame, name in ((concepts, "concepts"), (feedback, "prf_terms"), (best, "bm25_terms")):
        meta = meta.join(listed(frame, name), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    meta = meta.join(counts.withColumnRenamed("bm25_terms", "n_scored_terms"), "query_id", "left").withColumn("n_scored_terms", F.coalesce("n_scored_terms", F.lit(0)))
    return rated.select("query_id", "doc_id", "ord", "score", "bm25_boost", "hybrid_score", "quality_score", "final_score", "rank"), meta
