"""Queries of the knowledge graph, with fixture patterns for the invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators import bm25
from rankframe.operators import graph as G
from rankframe.plans.common import dealt, registering, table
from rankframe.plans.retrieval import BM25_SQL, K, _passages

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

PATTERNS = ("[a-z]*tion[a-z]*", "[a-z]*heit[a-z]*", "[a-z]*mente", "[a-z]*ment[a-z]*")
VERBS = ("the", "of", "and", "de", "der")
MENTIONS_SQL = "me AS (SELECT doc_id, unnest(list_distinct(" + " || ".join(f"regexp_extract_all(lower(text), '{p}')" for p in PATTERNS) + ")) AS entity FROM documents)"
EDGES_SQL = (
    MENTIONS_SQL
    + ", rw AS ("
    + " UNION ALL ".join(rf"SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{M}}\p{{N}}_]+)\s+{v}\s+([\p{{L}}\p{{M}}\p{{N}}_]+)', 1)) AS src, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{M}}\p{{N}}_]+)\s+{v}\s+([\p{{L}}\p{{M}}\p{{N}}_]+)', 2)) AS dst, '{v}' AS relationship FROM documents" for v in VERBS)
    + "), ok AS (SELECT rw.* FROM rw JOIN me a ON rw.doc_id = a.doc_id AND rw.src = a.entity JOIN me b ON rw.doc_id = b.doc_id AND rw.dst = b.entity), ed AS (SELECT src, dst, max(struct_pack(d := doc_id, r := relationship)) AS x FROM ok GROUP BY ALL)"
)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = dealt(table(spark, sf_dir, "documents"))
    mentioned = G.mentions(docs, PATTERNS)
    return mentioned, G.relations(docs, mentioned, [rf"{v}" for v in VERBS], kinds=PATTERNS)


@register(f"WITH {MENTIONS_SQL} SELECT entity, count(DISTINCT doc_id) AS n_chunks FROM me GROUP BY 1")
def entity_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G6."""
    return G.degrees(G.mentions(table(spark, sf_dir, "documents"), PATTERNS))


@register(f"WITH {MENTIONS_SQL}, md AS (SELECT DISTINCT doc_id, entity FROM me) SELECT x.entity AS a, y.entity AS b, count(*) AS n_chunks FROM md x JOIN md y ON x.doc_id = y.doc_id AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 3")
def entity_cooccurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities that stand together in three documents or more."""
    return G.cooccurrences(G.mentions(dealt(table(spark, sf_dir, "documents")), PATTERNS), 3)


@register(f"WITH {EDGES_SQL} SELECT src, dst, x.r AS relationship, 0.8::DOUBLE AS confidence, x.d AS doc_id FROM ed")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each pair, the last document wins."""
    return _graph(spark, sf_dir)[1].select("src", "dst", "relationship", "confidence", "doc_id")


@register()
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of entities near those of each query enter its results."""
    mentioned, edges = _graph(spark, sf_dir)
    queries = _passages(spark, sf_dir)
    seeds = G.mentions(queries.select(F.col("query_id").alias("doc_id"), "text"), PATTERNS).select(F.col("doc_id").alias("key"), "entity")
    related = G.neighbourhood(edges, seeds).select(F.col("key").alias("query_id"), "entity")
    run = bm25.search(dealt(table(spark, sf_dir, "documents")), queries, K)
    return G.expanded(run, related, mentioned).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), sd AS (SELECT s_suppkey AS key, s_suppkey AS entity FROM supplier WHERE s_nationkey = 1),
r AS (SELECT key, entity, 0 AS hop FROM sd UNION SELECT r.key, b.dst, r.hop + 1 FROM r JOIN b ON r.entity = b.src WHERE r.hop < 2)
SELECT key, entity, min(hop)::BIGINT AS hop FROM r GROUP BY ALL HAVING min(hop) > 0"""
)
def supplier_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 on the graph of suppliers and parts: two steps around the suppliers of one nation."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 1").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("entity"))
    return G.neighbourhood(edges, seeds).select("key", "entity", F.col("hop").cast("long").alias("hop"))
