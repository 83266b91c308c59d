"""A term corpus that is kept up: counts by part of the input, of which only changed, new or aged parts are counted again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.operators import dense
from rankframe.operators.search import corpus_terms, term_corpus
from rankframe.sources.scratch import written

#: Seconds after which a part is counted again even if nothing is known to have changed.
MAX_AGE = 3600
_COLUMNS = ("part", "version", "size", "built_at", "term", "n_docs")


def _versions(docs: DataFrame, part: str, changed: str) -> DataFrame:
    """(part, version, n_docs): a part is told from its earlier state by its latest change and its number of documents."""
    return docs.groupBy(F.col(part).alias("part")).agg(F.max(changed).alias("version"), F.count(F.lit(1)).alias("size"))


def counted(docs: DataFrame, part: str, changed: str, phrases: Sequence[str], triggers: Sequence[str], built_at: Column) -> DataFrame:
    """The store (part, version, size, built_at, term, n_docs): how many documents of each part have a term; one row with a null term for each part."""
    terms = docs.select(F.col(part).alias("part"), F.explode(corpus_terms(F.col("text"), phrases, triggers)).alias("term")).groupBy("part", "term").agg(F.count(F.lit(1)).alias("n_docs"))
    heads = _versions(docs, part, changed).withColumn("built_at", built_at)
    own = terms.withColumnRenamed("part", "_part").join(heads, F.col("_part").eqNullSafe(F.col("part"))).drop("_part")
    return own.select(*_COLUMNS).unionByName(heads.select("part", "version", "size", "built_at", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n_docs")))


def changes(store: DataFrame, docs: DataFrame, part: str, changed: str, now: Column, max_age: int = MAX_AGE) -> DataFrame:
    """(part, state): new, changed, aged, same, or gone for a part of the store without documents."""
    held = store.where("term is null").select(F.col("part").alias("_part"), F.col("version").alias("_version"), F.col("size").alias("_size"), "built_at")
    both = _versions(docs, part, changed).join(held, F.col("part").eqNullSafe(F.col("_part")), "full_outer")
    old = F.unix_timestamp(now) - F.unix_timestamp("built_at") > max_age
    same = F.col("version").eqNullSafe(F.col("_version")) & (F.col("size") == F.col("_size"))
    state = F.when(F.col("size").isNull(), "gone").when(F.col("_size").isNull(), "new").when(~same, "changed").when(old, "aged").otherwise("same")
    return both.select(F.when(F.col("size").isNull(), F.col("_part")).otherwise(F.col("part")).alias("part"), state.alias("state"))


def refreshed(store: DataFrame, docs: DataFrame, part: str, changed: str, phrases: Sequence[str], triggers: Sequence[str], now: Column, max_age: int = MAX_AGE) -> tuple[DataFrame, DataFrame]:
    """The store as it is now, and the changes that were met.

    Texts are read of new, changed and aged parts alone; the counts of the others are taken over, those of parts that are gone left
    out. A null part is a part. An empty store gives a full build, an empty table an empty store.
    """
    met = changes(store, docs, part, changed, now, max_age)
    named = met.withColumnRenamed("part", "_p")
    again = docs.join(named.where("state in ('new', 'changed', 'aged')"), F.col(part).eqNullSafe(F.col("_p")), "left_semi")
    kept = store.join(named.where("state = 'same'"), F.col("part").eqNullSafe(F.col("_p")), "left_semi")
    return kept.unionByName(counted(again, part, changed, phrases, triggers, now)), met


def merged(store: DataFrame) -> DataFrame:
    """(term, n_docs) over all parts of a store."""
    return store.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("n_docs"))


def seeded(docs: DataFrame, seeds: DataFrame, types: Sequence[str], embed: Callable[[Column], Column], phrases: Sequence[str], triggers: Sequence[str], k: int = 50) -> DataFrame:
    """(term, n_docs) of the documents that any seed (seed) finds among its k nearest of any of the types.

    docs: (doc_id, text, embedding, document_type). All seeds of all types are one search, filtered before its cut; a document counts once.
    """
    asked = seeds.select("seed", embed(F.col("seed")).alias("embedding"), F.explode(F.array(*map(F.lit, types))).alias("kind"))
    asked = asked.select(F.struct("seed", "kind").alias("query_id"), "embedding", F.array("kind").alias("document_type"))
    vectors = written(docs.select("doc_id", "embedding", "document_type"), "vectors")  # embedded once
    found = dense.nearest(vectors, asked, k, filters=("document_type",)).select("doc_id").distinct()
    return term_corpus(docs.join(found, "doc_id", "left_semi"), phrases, triggers)
