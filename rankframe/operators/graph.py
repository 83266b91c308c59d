"""The knowledge graph: entity mentions, relation edges, neighbourhoods and expansion of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators.bm25 import MOST_BROADCAST_TERMS, small
from rankframe.sources.scratch import written

#: Verbs of relations.
VERBS = ("treats", "causes", "prevents", "increases", "decreases", "associated_with", "contraindicated")
BOOST, NEIGHBOURS, HOPS = 0.15, 10, 2


def mentions(chunks: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """(doc_id, entity), distinct: lower-cased matches of any pattern.

    The outer explode keeps the optimiser from looking through every text a second time in a filter for texts that have any.
    """
    found = T.let(F.lower(text), lambda low: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(from_start(p)), F.lit(0)) for p in patterns]))))
    return chunks.select("doc_id", F.explode_outer(found).alias("entity")).where("entity is not null")


def from_start(pattern: str) -> str:
    """A pattern that begins with any letters is tried only where a run of letters begins: what matches within the run matches from there, and
    what follows a match in its run can't match, since the letters before took as many as they could. The matches are the same."""
    return f"(?<![a-z]){pattern}" if pattern.startswith("[a-z]*") and "|" not in pattern and pattern[6:7] not in ("?", "+") else pattern


def relations(chunks: DataFrame, mentioned: DataFrame, verbs: Sequence[str] = VERBS, text: str = "text", kinds: Sequence[str] = ()) -> DataFrame:
    """(src, dst, relationship, confidence, context, doc_id): `word verb word` where both are entities of the chunk; the last chunk wins.

    A text is read once for all verbs, each word once for each verb: a word is taken whole, so no part of it is tried again. kinds:
    patterns one of which matches each entity as a whole; pairs of other words don't leave their row.
    """
    whole = "^(?:" + "|".join(f"(?:{p})" for p in kinds) + ")$"

    def found(low: Column, v: str) -> Column:
        pairs = F.regexp_extract_all(low, F.lit(rf"(?U)(?<!\w)\w++\s++{v}\s++\w++"), F.lit(0))  # letters of any script
        ends = F.transform(pairs, lambda m: T.let(F.split(m, r"(?U)\s+"), lambda x: F.struct(F.get(x, F.lit(0)).alias("src"), F.element_at(x, -1).alias("dst"), F.lit(v).alias("relationship"))))
        ends = F.filter(ends, lambda x: x["src"].rlike(whole) & x["dst"].rlike(whole)) if kinds else ends
        return F.when(F.contains(low, F.lit(v)), ends).otherwise(F.array().cast("array<struct<src:string,dst:string,relationship:string>>"))

    every = T.let(F.lower(text), lambda low: F.flatten(F.array(*[found(low, v) for v in verbs])))
    rows = chunks.select("doc_id", F.left(text, F.lit(200)).alias("context"), F.explode(every).alias("p")).select("doc_id", "context", "p.*")
    rows = written(rows, "relations")
    held = written(mentioned.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "entities")
    rows = rows.join(held.withColumnRenamed("entity", "src"), ["doc_id", "src"], "left_semi").join(held.withColumnRenamed("entity", "dst"), ["doc_id", "dst"], "left_semi")
    last = rows.groupBy("src", "dst").agg(F.max(F.struct("doc_id", "relationship", "context")).alias("x"))
    return last.select("src", "dst", F.col("x.relationship").alias("relationship"), F.lit(0.8).alias("confidence"), F.col("x.context").alias("context"), F.col("x.doc_id").alias("doc_id"))


def cooccurrences(mentioned: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n_chunks) with a < b: in how many chunks both entities stand, at least `least` of them.

    Entities of fewer chunks have no such pair. The others are numbered in their order, so that pairs are two numbers until they are
    counted; they are made within a chunk, entity by entity, and counted before they are shuffled.
    """
    held = written(mentioned.distinct(), "mentions")
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    names = written(often.select("entity").orderBy("entity").select(F.monotonically_increasing_id().alias("e"), "entity"), "numbers")  # parts of the range rise
    numbered = held.join(small(names, MOST_BROADCAST_TERMS), "entity").groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    each = numbered.select("es", F.posexplode("es").alias("i", "a")).select("a", F.explode_outer(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b")).where("b is not null")
    counts = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_chunks")).where(F.col("n_chunks") >= least)
    of = lambda end: small(names.select(F.col("e").alias(end), F.col("entity").alias(f"_{end}")), MOST_BROADCAST_TERMS)
    return counts.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n_chunks")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, entity, hop): entities within `hops` undirected steps of each key's seeds (key, entity), without the seeds.

    Edges may repeat: what a step reaches is made distinct, not the edges, of which a task would have to hold its share.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("key", "entity", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier["entity"] == both["src"]).select("key", F.col("dst").alias("entity")).distinct()
        frontier = step.join(seen.select("key", "entity"), ["key", "entity"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def expanded(results: DataFrame, related: DataFrame, mentioned: DataFrame, most: int = NEIGHBOURS, boost: float = BOOST) -> DataFrame:
    """Results (query_id, doc_id, score) and up to `most` chunks of related entities (query_id, entity) that they lack, at the boost score.

    A query takes the chunks of smallest id. It holds at most as many chunks as the largest result, so of each entity only `most`
    and as many chunks can enter: an entity of most chunks brings no more than these into the join.
    """
    held = results.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    first = mentioned.select("entity", "doc_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))).where(F.col("r") <= most + held).drop("r")
    more = related.join(first, "entity").select("query_id", "doc_id").distinct().join(results.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    more = more.withColumn("r", rank).where(F.col("r") <= most).select("query_id", "doc_id", F.lit(boost).alias("score"))
    every = results.select("query_id", "doc_id", "score").unionByName(more)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")))


def degrees(mentioned: DataFrame) -> DataFrame:
    """(entity, n_chunks)."""
    return mentioned.groupBy("entity").agg(F.count_distinct("doc_id").alias("n_chunks"))
