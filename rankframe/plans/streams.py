"""Queries that run as streams over all rows of a table and end when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.plans import ingesting
from rankframe.plans.common import registering, table
from rankframe.sources.scratch import scratch
from rankframe.streaming import ingest, measurements

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@register("SELECT event_id, user_id FROM events")
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: every event is sent twice and kept once."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = measurements.deduplicated(events.unionByName(events), "event_id").select("event_id", "user_id")
    path = scratch(spark, "feedback")
    kept.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(kept.schema).parquet(path)


@register(f"WITH c AS ({ingesting.ORACLES['document_chunks']}) SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY 1")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split as they arrive; chunks of each one's last version."""
    path = scratch(spark, "chunks")
    ingest.ingest(_stream(spark, sf_dir, "documents").select("doc_id", "text"), path, scratch(spark, "progress")).awaitTermination()
    return ingest.current(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
