"""Queries of hard negatives, triplets and preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators import bm25
from rankframe.operators import training as N
from rankframe.plans.common import dealt, registering, table
from rankframe.plans.retrieval import BM25_SQL, K, QRELS_SQL, _passages
from rankframe.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

CANDIDATES_SQL = f"{BM25_SQL}, {QRELS_SQL}, ca AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM run WHERE score > 0.1 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM rel))"
BOUNDARY_SQL = f"{CANDIDATES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ca), bo AS (SELECT query_id, doc_id, CASE WHEN n <= 5 THEN pos ELSE pos - n // 3 END AS pick FROM n WHERE n <= 5 OR (pos > n // 3 AND pos <= 2 * n // 3 AND pos - n // 3 <= 5))"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, queries = dealt(table(spark, sf_dir, "documents")), _passages(spark, sf_dir)
    index, stats = bm25.indexed(docs, bm25.query_terms(queries).select("term").distinct())
    qrels = written(bm25.containing(docs, queries, index), "qrels")  # read more than once, as the candidates are
    return written(N.candidates(bm25.search(docs, queries, K, index=index, stats=stats), qrels), "candidates"), qrels


@register(f"WITH {CANDIDATES_SQL} SELECT query_id, doc_id, pos FROM ca")
def negative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, J5, N1."""
    return _parts(spark, sf_dir)[0].select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))


@register(f"WITH {BOUNDARY_SQL} SELECT query_id, doc_id, pick FROM bo")
def boundary_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4, W6."""
    return N.boundary(_parts(spark, sf_dir)[0], 5).select("query_id", "doc_id", F.col("pick").cast("long").alias("pick"))


@register(
    f"""WITH {CANDIDATES_SQL}, n AS (SELECT ca.*, d.lang, d.source, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, lang ORDER BY pos) AS ok, count(*) OVER (PARTITION BY query_id, lang) AS kn, min(pos) OVER (PARTITION BY query_id, lang) AS kf FROM ca JOIN documents d USING (doc_id)),
t AS (SELECT *, CASE WHEN ok <= greatest(1, kn // 2) THEN 0 ELSE 1 END AS turn FROM n), g AS (SELECT *, min(pos) OVER (PARTITION BY query_id, turn, source) AS gf FROM t),
pk AS (SELECT *, CASE WHEN n <= 5 THEN pos ELSE row_number() OVER (PARTITION BY query_id ORDER BY turn, CASE WHEN turn = 0 THEN kf ELSE gf END, pos) END AS pick FROM g) SELECT query_id, doc_id, pick FROM pk WHERE n <= 5 OR pick <= 5"""
)
def diverse_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over languages, then sources."""
    found = _parts(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return N.diverse(found, 5, "lang", F.col("source")).select("query_id", "doc_id", F.col("pick").cast("long").alias("pick"))


@register(
    rf"""WITH {CANDIDATES_SQL}, w AS (SELECT ca.query_id, ca.doc_id, ca.pos, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS b FROM ca JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = ca.query_id),
s AS (SELECT query_id, doc_id, pos, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END AS sim FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, pos) AS pick FROM s) SELECT query_id, doc_id, round(sim, 6) AS similarity, pick FROM k WHERE pick <= 5"""
)
def semantic_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates most like the passage asked for."""
    found = _parts(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return N.semantic(found, _passages(spark, sf_dir), 5).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), F.col("pick").cast("long").alias("pick"))


@register(f"WITH {BOUNDARY_SQL} SELECT rel.query_id, rel.doc_id AS positive, bo.doc_id AS hard_negative, pick AS place FROM rel JOIN bo USING (query_id) WHERE pick <= 3")
def training_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N7, N9."""
    found, qrels = _parts(spark, sf_dir)
    return N.triplets(qrels, N.boundary(found, 5)).withColumn("place", F.col("place").cast("long"))


@register(
    """WITH f AS (SELECT d.doc_id // 20 AS prompt, d.doc_id::VARCHAR AS response, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 WHEN l.toxic = 1 THEN -1 ELSE 0 END AS feedback FROM documents d JOIN labels l USING (doc_id))
SELECT g.prompt, g.response AS chosen, b.response AS rejected FROM f g JOIN f b ON g.prompt = b.prompt AND g.feedback = 1 AND b.feedback = -1"""
)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad documents of twenty neighbouring ids as answers to one prompt."""
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    mark = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("toxic") == 1, -1).otherwise(0)
    return N.preference_pairs(both.select(F.floor(F.col("doc_id") / 20).alias("prompt"), F.col("doc_id").cast("string").alias("response"), mark.alias("feedback")), "prompt")


@register("SELECT doc_id, quality, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS used_in_training, (SELECT count(*) FROM labels WHERE toxic = 0) >= 200 AS ready FROM labels")
def feedback_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels exported for training are marked; ready once 200 are left."""
    labels = table(spark, sf_dir, "labels").withColumn("used_in_training", F.lit(False))
    marked = N.marked_used(labels, labels.where("toxic = 1"), "doc_id")
    gate = marked.agg((F.count(F.when(~F.col("used_in_training"), 1)) >= 200).alias("ready"))
    return marked.select("doc_id", "quality", "used_in_training").crossJoin(F.broadcast(gate))
