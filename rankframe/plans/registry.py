"""The registered queries of the library and their SQL, collected from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankframe.plans import catalogue, composed, conversing, graphing, ingesting, laddering, learning, monitoring, retrieval, scoring, streams, texts

MODULES = (texts, retrieval, scoring, ingesting, graphing, learning, monitoring, conversing, catalogue, composed, laddering, streams)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_evaluated(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
