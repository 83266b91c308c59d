"""Queries of BM25, dense retrieval and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators import bm25, dense, metrics
from rankframe.plans.common import dealt, registering, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)
K = 20


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM benchmark) GROUP BY ALL),
qt AS (SELECT DISTINCT term FROM q),
p AS (SELECT doc_id, term, len AS doc_len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
raw AS (SELECT term, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM p, st GROUP BY term),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
sc AS (SELECT q.query_id, p.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl)) * q.n) AS score FROM p JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0),
run AS (SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 20)"""
QRELS_SQL = "rel AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
METRICS_SQL = """
tr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
h AS (SELECT run.query_id, run.doc_id, run.rank, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM run LEFT JOIN rel ON run.query_id = rel.query_id AND run.doc_id = rel.doc_id),
h2 AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM h),
a AS (SELECT query_id, count(*) AS n_retrieved, sum(rel)::BIGINT AS n_hits, sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN so_far::DOUBLE / rank ELSE 0 END) AS ap,
  sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS h3, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10 FROM h2 GROUP BY 1),
m AS (SELECT a.*, coalesce(n_relevant, 0)::BIGINT AS n_relevant, n_relevant IS NOT NULL AS has_truth, CASE WHEN n_relevant IS NULL THEN 0.0 ELSE n_hits::DOUBLE / n_retrieved END AS precision, CASE WHEN n_relevant IS NULL THEN 0.0 ELSE n_hits::DOUBLE / n_relevant END AS recall,
  CASE WHEN n_relevant IS NULL THEN 0.0 ELSE dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= n_relevant) END AS ndcg, CASE WHEN n_relevant IS NOT NULL THEN coalesce(1.0 / first, 0.0) END AS mrr, CASE WHEN n_relevant IS NOT NULL THEN ap / n_relevant END AS map FROM a LEFT JOIN tr USING (query_id)),
ev AS (SELECT query_id, n_retrieved, n_relevant, n_hits, has_truth, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN n_hits > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(map, 6) AS map, h1::DOUBLE AS p_1, round(h3 / 3.0, 6) AS p_3, h5 / 5.0 AS p_5, h10 / 10.0 AS p_10 FROM m)"""
DENSE_SQL = """
u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pr AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.e, b.e) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pr),
run AS (SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 10)"""


def _rounded(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(*[F.round(c, 6).alias(c) if c in metrics.METRICS else F.col(c).cast("long").alias(c) if c.startswith("n_") else F.col(c) for c in evaluated.columns])


@register(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM run")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    return bm25.search(dealt(table(spark, sf_dir, "documents")), _passages(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"WITH {QRELS_SQL} SELECT * FROM rel")
def passage_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM12: documents that hold a benchmark passage word for word."""
    return bm25.containing(table(spark, sf_dir, "documents"), _passages(spark, sf_dir))


@register(f"WITH {BM25_SQL}, {QRELS_SQL}, {METRICS_SQL} SELECT * FROM ev")
def bm25_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 to E5, J4, W2, T2."""
    docs, passages = dealt(table(spark, sf_dir, "documents")), _passages(spark, sf_dir)
    index, stats = bm25.indexed(docs, bm25.query_terms(passages).select("term").distinct())  # one index for the run and the judgements
    return _rounded(metrics.per_query(bm25.search(docs, passages, K, index=index, stats=stats), bm25.containing(docs, passages, index)))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return dense.nearest(v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.select(F.col("vec_id").alias("query_id"), "embedding"), 10, other_than_self=True)


@register(f"WITH {DENSE_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM run")
def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top ten of every vector among all others."""
    return _neighbours(spark, sf_dir).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _wanted(queries: DataFrame) -> DataFrame:
    """Filters of vectors: documents of one of two sources, and of a language or two; every third vector takes any of one of them."""
    sources = F.array(*[F.concat(F.lit("src"), ((F.col("query_id") + k) % 25).cast("string")) for k in (0, 7)])
    langs = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("fr")))
    return queries.withColumns({"source": F.when(F.col("query_id") % 3 != 1, sources), "lang": F.when(F.col("query_id") % 3 != 2, langs)})


@register(
    """WITH d AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e, source, lang FROM embeddings JOIN documents ON doc_id = vec_id),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 3 <> 1 THEN ['src' || (vec_id % 25), 'src' || ((vec_id + 7) % 25)] END AS sources, CASE WHEN vec_id % 3 <> 2 THEN CASE WHEN vec_id % 2 = 0 THEN ['en'] ELSE ['de', 'fr'] END END AS langs FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, doc_id, list_cosine_similarity(q.e, d.e) AS score FROM q JOIN d ON q.query_id <> d.doc_id AND (sources IS NULL OR list_contains(sources, source)) AND (langs IS NULL OR list_contains(langs, lang)))
SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p QUALIFY rank <= 10"""
)
def filtered_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of those that pass each query's own filters, which are applied before the cut. Queries: ids divisible by 20, against all."""
    v, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    chunks = v.select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id", "source", "lang"), "doc_id")
    queries = _wanted(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    found = dense.nearest(chunks, queries, 10, other_than_self=True, filters=("source", "lang"))
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    index = dense.CellIndex(v.select(F.col("vec_id").alias("doc_id"), "embedding"))
    return index.nearest(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, other_than_self=True)


@register()
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, approximate: the ten nearest by inverted lists, of ids divisible by 20 among all; its recall is indexed_recall."""
    return _indexed(spark, sf_dir).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"WITH {DENSE_SQL} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, TRUE AS reached, TRUE AS exact_scores FROM run WHERE query_id % 20 = 0")
def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, approximate: whether the lists give 0.9 of the exact neighbours, and each that they share the exact score."""
    v = table(spark, sf_dir, "embeddings")
    exact = dense.nearest(v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, other_than_self=True)
    both = exact.join(_indexed(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("_s")), ["query_id", "doc_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"), (F.count("_s") >= 0.9 * F.count(F.lit(1))).alias("reached"),
        F.coalesce(F.bool_and(F.abs(F.col("_s") - F.col("score")) < 1e-9), F.lit(True)).alias("exact_scores"),
    )


def dense_run_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    run = _neighbours(spark, sf_dir)
    labelled = run.join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    hits = labelled.withColumn("rel", (F.col("ql") == F.col("dl")).cast("int"))
    per = hits.groupBy("query_id", F.col("ql").alias("label")).agg(F.sum("rel").alias("n_hits"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    return per.join(sizes.withColumnRenamed("n", "size"), "label").select("query_id", (F.col("n_hits") / F.col("n")).alias("precision"), (F.col("n_hits") / (F.col("size") - 1)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


@register(
    f"""WITH {DENSE_SQL}, h AS (SELECT query_id, rank, qa.label, (qa.label = qb.label)::INT AS rel FROM run JOIN embeddings qa ON qa.vec_id = query_id JOIN embeddings qb ON qb.vec_id = doc_id),
sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1),
pq AS (SELECT query_id, sum(rel) / count(*)::DOUBLE AS precision, sum(rel)::DOUBLE / (any_value(size) - 1) AS recall, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0.0) AS mrr FROM h JOIN sz USING (label) GROUP BY 1),
lg AS (UNPIVOT pq ON precision, recall, mrr INTO NAME metric VALUE value)
SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max FROM lg GROUP BY 1"""
)
def dense_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, deviations, medians and extremes of the metrics of the dense run."""
    found = metrics.summary(dense_run_evaluated(spark, sf_dir).withColumn("has_truth", F.lit(True)), ("precision", "recall", "mrr"))
    return found.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "min", "max")])


@register(f"WITH {BM25_SQL} SELECT query_id, d.source AS kind, count(*) AS n FROM run JOIN documents d USING (doc_id) GROUP BY ALL")
def hit_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the hits of each query."""
    docs = table(spark, sf_dir, "documents")
    run = bm25.search(dealt(docs), _passages(spark, sf_dir), K).join(docs.select("doc_id", F.col("source").alias("kind")), "doc_id")
    return metrics.distribution(run, "kind")


@register(
    f"""WITH {BM25_SQL}, c AS (SELECT query_id, doc_id, score, lang, source, ('src' || (query_id % 25)::VARCHAR) AS want_source, CASE query_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS want_lang FROM run JOIN documents USING (doc_id)),
l AS (SELECT *, source = want_source AND lang = want_lang AS l0, source = want_source AS l1, lang = want_lang AS l2 FROM c),
b AS (SELECT *, CASE WHEN bool_or(l0) OVER w THEN 0 WHEN bool_or(l1) OVER w THEN 1 WHEN bool_or(l2) OVER w THEN 2 END AS level FROM l WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, level::BIGINT AS level FROM b WHERE (level = 0 AND l0) OR (level = 1 AND l1) OR (level = 2 AND l2)"""
)
def relaxed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and region filters, relaxed where they leave nothing."""
    docs = table(spark, sf_dir, "documents")
    run = bm25.search(dealt(docs), _passages(spark, sf_dir), K).join(docs.select("doc_id", "lang", "source"), "doc_id")
    source = F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string"))
    region = F.col("lang") == F.when(F.col("query_id") % 3 == 0, "de").when(F.col("query_id") % 3 == 1, "fr").otherwise("en")
    return dense.relaxed(run, [source & region, source, region]).select("query_id", "doc_id", F.col("level").cast("long").alias("level"))
