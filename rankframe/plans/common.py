"""How a module of queries registers them: a decorator that keeps the function and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The words left out of queries, as SQL literals for the oracles, written out apart from the library's own list.
STOP_LIST = ", ".join(
    f"'{w}'"
    for w in (
        "the and for with from that this have will shall under when into upon such which been were your their than about each within while those these there after before "
        "during because other where patients patient should could would might effect effects used using use dose doses per day days week weeks month months or of via onto"
    ).split()
)


def registering(queries: dict, oracles: dict) -> Callable:
    def register(sql: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A scan whose rows come from fewer splits than there are cores, dealt anew, so that work on few large row groups is spread; others
    stay as they are. Splits are counted by their rows, which the footers tell: a row group of many splits is read by one of them.

    What is shuffled is at most a row group for each core, however large the cluster.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.select(F.spark_partition_id().alias("split")).groupBy("split").count().count() < cores else scan
