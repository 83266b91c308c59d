"""Retrieval metrics of ranked runs against relevance judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "ndcg", "mrr", "map", "p_1", "p_3", "p_5", "p_10")


def per_query(ranked: DataFrame, qrels: DataFrame, cut: int = 10) -> DataFrame:
    """One row per query of the run: counts, precision, recall, F1, NDCG@cut, reciprocal rank, average precision and P@1,3,5,10.

    ranked: (query_id, doc_id, rank); qrels: (query_id, doc_id). Without judgements the metrics are 0 and mrr and map null,
    with has_truth false. P@k is over k even where fewer were found.
    """
    wanted = qrels.select("query_id", "doc_id").distinct()
    truth = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.select("query_id", "doc_id", "rank").join(wanted.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("so_far", so_far)
    gain = F.when((F.col("rank") <= cut) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    sums = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_retrieved"), F.sum("rel").alias("n_hits"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"), *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}") for k in (1, 3, 5, 10)],
    )
    both = sums.join(truth, "query_id", "left").withColumn("has_truth", F.col("n_relevant").isNotNull()).withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest("n_relevant", F.lit(1)), F.lit(cut)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known = F.col("has_truth")
    precision, recall = F.col("n_hits") / F.col("n_retrieved"), F.when(known, F.col("n_hits") / F.col("n_relevant")).otherwise(0.0)
    return both.select(
        "query_id", "n_retrieved", "n_relevant", "n_hits", "has_truth", F.when(known, precision).otherwise(0.0).alias("precision"), recall.alias("recall"),
        F.when(F.col("n_hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), F.when(known, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(known, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.when(known, F.col("ap") / F.col("n_relevant")).alias("map"), *[(F.col(f"h{k}") / F.lit(float(k))).alias(f"p_{k}") for k in (1, 3, 5, 10)],
    )


def summary(evaluated: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(metric, n, mean, std, median, min, max) over queries with judgements; std is of the population."""
    long = evaluated.where("has_truth").unpivot(["query_id"], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, baseline, delta, percent) for two (metric, mean) tables; percent is 0 where the baseline is 0."""
    both = current.select("metric", F.col("mean").alias("value")).join(baseline.select("metric", F.col("mean").alias("baseline")), "metric")
    delta = F.col("value") - F.col("baseline")
    return both.withColumn("delta", delta).withColumn("percent", F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).otherwise(0.0))


def distribution(ranked: DataFrame, kind: str) -> DataFrame:
    """(query_id, kind, n): how the hits of each query spread over kinds."""
    return ranked.groupBy("query_id", kind).agg(F.count(F.lit(1)).alias("n"))
