"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

The columns of documents, and whatever columns they have besides, pass through all stages but the last unchanged, whatever their
names. Documents are told apart by id and text: repeated ids, and rows without an id, are documents like any others. Every stage
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import bpe, language_id, mixing, resampling, simhash
from rankframe.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws: as many as come near the log weight of all but 0.2% of good labelled text.

    Null and empty texts weigh nothing for or against and stay unless the cut is above that; without labels all stay.
    """
    return resampling.resampled_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: what is null, empty or without a letter goes, and what scores far below
    nearly all documents of a known language. Where no document has a language to learn from, all with a letter stay."""
    return language_id.identified_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles whose Jaccard similarity is 0.8 or more.

    The smallest id stays, nulls last; texts without a word are one group.
    """
    return simhash.deduplicated(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights, in training order: a document stands in each pass of the mix that takes words of it.

    Documents without a word, and those behind a source's share, don't stand in the mix; a null source is a source.
    """
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens) of each document; null text has no ids."""
    return bpe.encoded(docs, keep=("doc_id", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", quality), ("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mix), ("byte-level BPE", encode)]

#: The quality, language and tokenizer models have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
