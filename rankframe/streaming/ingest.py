"""Documents that arrive as a stream, split into chunks and kept as versions, of which the last of each document counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankframe.operators import chunking


def ingest(stream: DataFrame, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Starts a run over what is there: chunks of (doc_id, text) go to `path`, a folder for each batch.

    A batch that is run again after a failure replaces its own folder and no other, so its chunks stand once. Splitting needs
    no state and no shuffle. A document that comes again gets a newer version; `current` leaves the older ones out.
    """

    def put(batch: DataFrame, number: int) -> None:
        made = chunking.chunks(batch, text).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document's last version."""
    kept = spark.read.parquet(path)
    last = kept.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return kept.join(last, ["doc_id", "batch"], "left_semi")
