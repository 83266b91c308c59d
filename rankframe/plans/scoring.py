"""Queries of query understanding, hybrid scores, expansion and re-ranking over the BM25 and dense runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import bm25
from rankframe.operators import scoring as S
from rankframe.plans.common import STOP_LIST, dealt, registering, table
from rankframe.plans.retrieval import BM25_SQL, K, _passages

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

#: Fixture lexicon: the invented prose has none of the domain's words.
GROUPS = {"specific": (r"tion ", r"ing "), "safety": (r"on ", r"the "), "dosing": (r"und ", r"que "), "concept": (r"of ", r"and "), "cardiac": (r"heart", r"thea")}
SECTIONS = (("src1", 0.25), ("src2", 0.15))
RULES = [("motion", 0, "tion", 2.0), ("motion", 0, "ing ", 1.5), ("place", 1, "the ", 1.0), ("place", 1, " on ", 2.5), ("german", 2, " und ", 3.0), ("german", 2, " der ", 2.0), ("romance", 3, " de ", 3.0), ("romance", 3, " la ", 1.0), ("general", 4, "zzzz", 1.0)]
CONCEPTS = [("articles", "the"), ("articles", "a"), ("articles", "das"), ("links", "and"), ("links", "und"), ("links", "y"), ("links", "et"), ("places", "in"), ("places", "on"), ("places", "at")]


def _count(group: str) -> str:
    return " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in GROUPS[group])


@register(
    f"""WITH c AS (SELECT item_id AS query_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS nw, {_count('specific')} AS sp, {_count('safety')} AS sa, {_count('dosing')} AS do_, {_count('concept')} AS co, {_count('cardiac')} AS ca FROM benchmark),
t AS (SELECT *, sp + sa + do_ + co + ca AS total, CASE WHEN sp > 0 THEN 'specific' WHEN sa > 0 THEN 'safety' WHEN do_ > 0 THEN 'dosing' WHEN co > 0 THEN 'concept' WHEN nw >= 4 AND sp + sa + do_ + co + ca >= 2 THEN 'complex' ELSE 'general' END AS query_type FROM c),
a AS (SELECT *, CASE query_type WHEN 'specific' THEN 0.8 WHEN 'concept' THEN 0.6 WHEN 'safety' THEN 0.7 WHEN 'dosing' THEN 0.5 WHEN 'general' THEN 0.4 ELSE 0.6 END::DOUBLE AS base_alpha,
  [CASE WHEN nw <= 2 THEN 0.1 ELSE 0.0 END, CASE WHEN nw >= 6 THEN -0.1 ELSE 0.0 END, CASE WHEN total >= 3 THEN 0.15 ELSE 0.0 END, CASE WHEN ca > 0 THEN 0.1 ELSE 0.0 END, CASE WHEN sa >= 2 THEN 0.05 ELSE 0.0 END, CASE WHEN contains(text, '?') THEN -0.05 ELSE 0.0 END]::DOUBLE[] AS st FROM t)
SELECT query_id, query_type, total::BIGINT AS n_terms, base_alpha, round(greatest(0.0, least(1.0, base_alpha + list_sum(st))), 6) AS alpha,
  round(CASE WHEN len(list_filter(st, lambda x: x <> 0)) = 0 THEN 0.5 ELSE least(1.0, least(0.9, 0.5 + 0.1 * len(list_filter(st, lambda x: x <> 0))) + CASE WHEN round(list_sum(list_transform(st, lambda x: abs(x))), 9) > 0.2 THEN 0.1 ELSE 0.0 END) END::DOUBLE, 6) AS confidence FROM a"""
)
def query_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5, R6, R7."""
    found = S.adaptive_alpha(_passages(spark, sf_dir), GROUPS)
    return found.select("query_id", "query_type", F.col("n_terms").cast("long").alias("n_terms"), "base_alpha", F.round("alpha", 6).alias("alpha"), F.round("confidence", 6).alias("confidence"))


_RULES_SQL = ", ".join(f"('{i}', {o}, '{p}', {w})" for i, o, p, w in RULES)


@register(
    f"""WITH r(intent, ord, pattern, weight) AS (VALUES {_RULES_SQL}),
s AS (SELECT item_id AS query_id, intent, ord, sum(CASE WHEN regexp_matches(lower(text), pattern) THEN weight::DOUBLE ELSE 0.0 END) AS score FROM benchmark, r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r FROM s)
SELECT query_id, max(CASE WHEN r = 1 THEN intent END) AS intent, max(CASE WHEN r = 1 THEN score END) AS score, round(CASE WHEN sum(score) > 0 THEN max(CASE WHEN r = 1 THEN score END) / sum(score) ELSE 0.5 END, 6) AS confidence,
  coalesce(string_agg(CASE WHEN r > 1 AND score > 0 THEN intent END, ',' ORDER BY r), '') AS alternatives FROM k WHERE r <= 3 GROUP BY 1"""
)
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17 with a fixture rule table."""
    rules = spark.createDataFrame(RULES, "intent string, ord int, pattern string, weight double")
    return S.intents(_passages(spark, sf_dir), rules).withColumn("confidence", F.round("confidence", 6))


def _run(spark: SparkSession, sf_dir: str, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = bm25.search(docs if index is not None else dealt(docs), _passages(spark, sf_dir), K, index=index, stats=stats)
    queries = _passages(spark, sf_dir).select("query_id", T.without(T.tokens(F.col("text"))).alias("query_tokens"))
    return hits.join(docs.select("doc_id", "text", "source"), "doc_id").join(queries, "query_id")


RUN_SQL = f"""{BM25_SQL},
hit AS (SELECT run.*, d.text, d.source, list_filter(regexp_extract_all(lower(b.text), '[a-z]{{2,}}'), lambda x: NOT list_contains([{STOP_LIST}], x)) AS query_tokens FROM run JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)"""


@register(
    f"""WITH {RUN_SQL}, f AS (SELECT *, length(text) AS n, len(query_tokens) AS asked, len(list_filter(query_tokens, lambda t: contains(lower(text), t))) AS found FROM hit),
s AS (SELECT *, greatest(-0.4, least(0.85, CASE WHEN n BETWEEN 400 AND 1200 THEN 0.2 WHEN n < 200 THEN -0.15 WHEN n > 1600 THEN -0.1 ELSE 0.0 END + CASE WHEN asked = 0 THEN 0.0 WHEN found > 0 THEN least(0.2, 0.25 * found / asked) ELSE -0.18 END + CASE WHEN contains(source, 'src1') THEN 0.25 WHEN contains(source, 'src2') THEN 0.15 ELSE 0.0 END))::DOUBLE AS quality_score FROM f)
SELECT query_id, doc_id, round(quality_score, 6) AS quality_score, round(score * (1 + quality_score), 4) AS final_score,
  concat_ws(',', CASE WHEN n BETWEEN 400 AND 1200 THEN 'ideal_length' WHEN n < 200 THEN 'too_short' WHEN n > 1600 THEN 'too_long' END, CASE WHEN asked = 0 THEN NULL WHEN found > 0 THEN 'query_coverage_' || found || '/' || asked ELSE 'no_query_terms' END, CASE WHEN contains(source, 'src1') THEN 'section_src1' WHEN contains(source, 'src2') THEN 'section_src2' END) AS factors FROM s"""
)
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8, R9, B5."""
    rows = S.quality_rescored(S.quality_bonus(_run(spark, sf_dir), section="source", sections=SECTIONS).withColumn("hybrid_score", F.lit(None).cast("double")))
    return rows.select("query_id", "doc_id", F.round("quality_score", 6).alias("quality_score"), F.round("final_score", 4).alias("final_score"), F.array_join("quality_factors", ",").alias("factors"))


@register(
    f"""WITH {RUN_SQL}, b AS (SELECT *, list_sum(list_transform(query_tokens, lambda t: CASE WHEN contains(lower(text), t) THEN length(t)::DOUBLE ELSE 0.0 END)) AS boost FROM hit)
SELECT query_id, doc_id, round(coalesce(boost, 0), 4) AS bm25_boost, CASE WHEN len(query_tokens) > 0 THEN round(0.6 * score + 0.4 * coalesce(boost, 0) / 10, 4) END AS hybrid_score FROM b"""
)
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the query that stand in a hit raise it."""
    hits = _run(spark, sf_dir)
    terms = _passages(spark, sf_dir).select("query_id", F.explode(T.without(T.tokens(F.col("text")))).alias("term")).withColumn("score", F.length("term").cast("double"))
    boosted = bm25.term_boost(hits, terms).withColumn("alpha", F.lit(0.6)).withColumn("bm25_terms", F.size("query_tokens"))
    return S.hybrid(boosted).select("query_id", "doc_id", F.round("bm25_boost", 4).alias("bm25_boost"), F.round("hybrid_score", 4).alias("hybrid_score"))


@register(
    f"""WITH {RUN_SQL}, s AS (SELECT query_id, doc_id, CASE WHEN len(query_tokens) > 0 THEN len(list_intersect(list_distinct(query_tokens), regexp_extract_all(lower(text), '[a-z]{{2,}}')))::DOUBLE / len(list_distinct(query_tokens)) ELSE 0.0 END AS o, score FROM hit WHERE trim(text) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(o, 9) DESC, doc_id) AS rk FROM s) SELECT query_id, doc_id, rk AS rerank_rank, round(o, 6) AS rerank_score, round(0.7 * o + 0.3 * score, 4) AS ensemble_score FROM k WHERE rk <= 10"""
)
def rerank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap as the pair scorer, joined with BM25 by id."""
    hits = _run(spark, sf_dir)
    best = S.reranked(hits, S.overlap_score(F.col("query_tokens"), F.col("text")), 10)
    long = best.select("query_id", "doc_id", F.explode(F.create_map(F.lit("overlap"), F.col("rerank_score"), F.lit("bm25"), F.col("score"))).alias("scorer", "score"))
    both = S.ensemble(long, {"overlap": 0.7, "bm25": 0.3})
    return best.join(both, ["query_id", "doc_id"]).select("query_id", "doc_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), F.round("rerank_score", 6).alias("rerank_score"), F.round("ensemble_score", 4).alias("ensemble_score"))


@register(
    f"""WITH {RUN_SQL}, g AS (SELECT query_id, source, count(*) AS n_chunks, avg(score) AS avg_score, sum(length(text)) + 2 * (count(*) - 1) AS n_chars FROM hit WHERE rank <= 15 GROUP BY ALL),
r AS (SELECT *, sum(n_chars) OVER (PARTITION BY query_id ORDER BY round(avg_score, 9) DESC, source ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT query_id, source, n_chunks, round(avg_score, 4) AS avg_score, n_chars::BIGINT AS n_chars FROM r WHERE run <= 25000"""
)
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits consolidated by source within a budget of characters."""
    return S.consolidated(_run(spark, sf_dir)).select("query_id", "source", "n_chunks", F.round("avg_score", 4).alias("avg_score"), F.length("text").cast("long").alias("n_chars"))


@register(
    f"""WITH {RUN_SQL}, g AS (SELECT query_id, source, doc_id % 4 AS page, count(*) AS n_chunks, avg(score) AS avg_score, sum(length(text)) + 2 * (count(*) - 1) AS n_chars FROM hit WHERE rank <= 15 GROUP BY ALL),
r AS (SELECT *, sum(n_chars) OVER (PARTITION BY query_id ORDER BY round(avg_score, 9) DESC, source, page ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT query_id, source, page, n_chunks, round(avg_score, 4) AS avg_score, n_chars::BIGINT AS n_chars FROM r WHERE run <= 25000"""
)
def page_groups_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits consolidated by source and page within a budget of characters."""
    found = S.consolidated(_run(spark, sf_dir).withColumn("page", F.col("doc_id") % 4), by=("source", "page"))
    return found.select("query_id", "source", "page", "n_chunks", F.round("avg_score", 4).alias("avg_score"), F.length("text").cast("long").alias("n_chars"))


@register(
    f"""WITH {RUN_SQL}, t AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM hit WHERE rank <= 3),
c AS (SELECT query_id, term, count(*) AS n FROM t WHERE term NOT IN ({STOP_LIST}) AND (query_id, term) NOT IN (SELECT (query_id, term) FROM q) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS rank FROM c) SELECT * FROM k WHERE rank <= 5"""
)
def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10."""
    return S.feedback_terms(_run(spark, sf_dir), bm25.query_terms(_passages(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


_CONCEPTS_SQL = ", ".join(f"('{c}', '{s}')" for c, s in CONCEPTS)


@register(
    f"""WITH c(concept, synonym) AS (VALUES {_CONCEPTS_SQL}), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{1,}}')) AS term FROM benchmark),
n AS (SELECT DISTINCT query_id, concept FROM q JOIN c ON q.term = c.synonym), w AS (SELECT DISTINCT query_id, synonym FROM n JOIN c USING (concept) WHERE (query_id, synonym) NOT IN (SELECT (query_id, term) FROM q))
SELECT * FROM (SELECT query_id, synonym, row_number() OVER (PARTITION BY query_id ORDER BY synonym) AS rank FROM w) WHERE rank <= 6"""
)
def concept_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11, J11 with a fixture ontology."""
    tokens = _passages(spark, sf_dir).select("query_id", F.explode(T.tokens(F.col("text"), "[a-z]{1,}")).alias("term")).distinct()
    concepts = spark.createDataFrame(CONCEPTS, "concept string, synonym string")
    return S.concept_variants(tokens, concepts).select("query_id", "synonym", F.col("rank").cast("long").alias("rank"))


def _shares(queries: list[str], texts: list[str]) -> list[float]:
    """The share of a query's words that its text has, as a stand-in for a model's scores of a batch of pairs."""
    out = []
    for q, t in zip(queries, texts):
        asked = set(q.split())
        out.append(len(asked & set(t.lower().split())) / len(asked) if asked else 0.0)
    return out


@register(
    f"""WITH {RUN_SQL}, s AS (SELECT h.query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(h.text), '\\s+'), lambda x: x <> '') AS t FROM hit h JOIN benchmark b ON b.item_id = h.query_id WHERE trim(h.text) <> ''),
k AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, t))::DOUBLE / len(a) ELSE 0.0 END AS o FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(o, 9) DESC, doc_id) AS rerank_rank FROM k) SELECT query_id, doc_id, rerank_rank, round(o, 6) AS rerank_score FROM r WHERE rerank_rank <= 10"""
)
def pair_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking by a function over batches of pairs."""
    asked = _passages(spark, sf_dir).select("query_id", F.lower("text").alias("_q"))
    best = S.reranked(_run(spark, sf_dir).join(asked, "query_id"), S.pair_scorer(_shares)(F.col("_q"), F.col("text")), 10)
    return best.select("query_id", "doc_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), F.round("rerank_score", 6).alias("rerank_score"))
