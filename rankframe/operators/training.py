"""Training data from retrieval runs: hard negatives, triplets, preference pairs and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions import text as T

LEAST_SCORE, MOST_CANDIDATES = 0.1, 20


def candidates(run: DataFrame, qrels: DataFrame, least: float = LEAST_SCORE, most: int = MOST_CANDIDATES) -> DataFrame:
    """The first `most` hits of each query that aren't relevant and score over `least`, with their place `pos` from 1."""
    left = run.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").where(F.col("score") > least)
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("pos") <= most)


def section_group(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.rlike("warning|adverse"), "safety").when(t.rlike("dosage|administration"), "dosing").when(t.rlike("contraindication"), "contraindication").otherwise("other")


def diverse(found: DataFrame, k: int, kind: str, group: Column) -> DataFrame:
    """Up to half (one at least) of each kind while the quota lasts, kinds by first appearance; then the rest by group. All if k or fewer."""
    q = Window.partitionBy("query_id")
    rows = found.withColumn("n", F.count(F.lit(1)).over(q)).withColumn("g", group)
    rows = rows.withColumn("of_kind", F.row_number().over(Window.partitionBy("query_id", kind).orderBy("pos"))).withColumn("kind_n", F.count(F.lit(1)).over(Window.partitionBy("query_id", kind))).withColumn("kind_first", F.min("pos").over(Window.partitionBy("query_id", kind)))
    share = F.greatest(F.lit(1), F.floor(F.col("kind_n") / 2))
    rows = rows.withColumn("turn", F.when(F.col("of_kind") <= share, 0).otherwise(1)).withColumn("g_first", F.min("pos").over(Window.partitionBy("query_id", "turn", "g")))
    order = Window.partitionBy("query_id").orderBy("turn", F.when(F.col("turn") == 0, F.col("kind_first")).otherwise(F.col("g_first")), "pos")
    rows = rows.withColumn("pick", F.when(F.col("n") <= k, F.col("pos")).otherwise(F.row_number().over(order)))
    return rows.where((F.col("n") <= k) | (F.col("pick") <= k)).drop("n", "g", "of_kind", "kind_n", "kind_first", "turn", "g_first")


def semantic(found: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """The k candidates most like any positive of their query by word Jaccard; both sides carry text."""
    pairs = found.join(positives.select("query_id", F.col("text").alias("positive")), "query_id")
    best = pairs.groupBy("query_id", "doc_id", "pos").agg(F.max(T.word_similarity(F.col("text"), F.col("positive"))).alias("similarity"))
    return best.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "pos"))).where(F.col("pick") <= k)


def boundary(found: DataFrame, k: int) -> DataFrame:
    """The first k of the middle third of each ranking; all where there are k or fewer."""
    rows = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    third = F.floor(F.col("n") / 3)
    place = F.when(F.col("n") <= k, F.col("pos")).otherwise(F.col("pos") - third)
    inside = (F.col("n") <= k) | ((F.col("pos") > third) & (F.col("pos") <= F.floor(2 * F.col("n") / 3)))
    return rows.withColumn("pick", place).where(inside & (F.col("pick") <= k)).drop("n")


def quality(negatives: DataFrame, kind: str, group: Column) -> DataFrame:
    """(query_id, n, quality): .3 of the mean score over .5, .3 of kinds over 3, .2 of groups over 5, .2 of the similarity, each at most whole."""
    sums = negatives.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.count_distinct(kind).alias("kinds"), F.count_distinct(group).alias("groups"), F.avg("similarity").alias("sim"))
    one = F.lit(1.0)
    return sums.select("query_id", "n", (0.3 * F.least(F.col("s") / 0.5, one) + 0.3 * F.least(F.col("kinds") / 3, one) + 0.2 * F.least(F.col("groups") / 5, one) + 0.2 * F.least(F.coalesce("sim", F.lit(0.0)), one)).alias("quality"))


def triplets(positives: DataFrame, negatives: DataFrame, each: int = 3) -> DataFrame:
    """(query_id, positive, hard_negative, place): each positive with the first negatives of its query."""
    return positives.select("query_id", F.col("doc_id").alias("positive")).join(negatives.where(F.col("pick") <= each).select("query_id", F.col("doc_id").alias("hard_negative"), F.col("pick").alias("place")), "query_id")


def preference_pairs(feedback: DataFrame, key: str) -> DataFrame:
    """(key, chosen, rejected): every good (feedback 1) with every bad (-1) response to the same prompt, different in text."""
    good = feedback.where("feedback = 1").select(key, F.col("response").alias("chosen")).distinct()
    bad = feedback.where("feedback = -1").select(key, F.col("response").alias("rejected")).distinct()
    return good.join(bad, key).where("chosen <> rejected")


def marked_used(feedback: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """The feedback with used_in_training true for the exported keys."""
    ids = exported.select(key).distinct().withColumn("_e", F.lit(True))
    return feedback.join(ids, key, "left").withColumn("used_in_training", F.coalesce("_e", "used_in_training", F.lit(False))).drop("_e")


def activated(models: DataFrame, target: object) -> DataFrame:
    return models.withColumn("is_active", F.col("model_id") == F.lit(target))


def adaptive(found: DataFrame, positives: DataFrame, kind: str, group: Column, target: float = 0.6, ks: tuple[int, ...] = (5, 8, 10)) -> DataFrame:
    """(query_id, doc_id, pick, strategy, k, quality): each query's first strategy and k whose negatives reach the target.

    Strategies diverse, semantic and boundary are tried in turn at each k in order, a k under .5 quality leading to the next; where
    none reaches the target, diverse at the last k stands. found carries text, score, kind and pos; quality is that of `quality`.
    """
    likeness = semantic(found, positives, MOST_CANDIDATES).select("query_id", "doc_id", "similarity")
    rows = found.join(likeness, ["query_id", "doc_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).withColumn("_g", group)
    kept = ["query_id", "doc_id", "pos", "score", kind, "_g", "similarity"]
    tries = None
    for turn, k in enumerate(ks):
        made = (
            ("diverse", diverse(rows, k, kind, F.col("_g"))),
            ("semantic", rows.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "pos"))).where(F.col("pick") <= k)),
            ("boundary", boundary(rows, k)),
        )
        for place, (name, frame) in enumerate(made):
            part = frame.select(*kept, F.col("pick").cast("long").alias("pick"), F.lit(name).alias("strategy"), F.lit(k).alias("k"), F.lit(3 * turn + place).alias("_try"))
            tries = part if tries is None else tries.unionByName(part)
    last = 3 * (len(ks) - 1)
    rated = tries.groupBy("query_id", "_try").agg(
        F.avg("score").alias("_s"), F.count_distinct(kind).alias("_kinds"), F.count_distinct("_g").alias("_groups"), F.avg("similarity").alias("_sim")
    )
    one = F.lit(1.0)
    rated = rated.select("query_id", "_try", (0.3 * F.least(F.col("_s") / 0.5, one) + 0.3 * F.least(F.col("_kinds") / 3, one) + 0.2 * F.least(F.col("_groups") / 5, one) + 0.2 * F.least("_sim", one)).alias("quality"))
    best = rated.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.round("quality", 9) >= target, F.col("_try"))), F.lit(last)).alias("_try"))
    chosen = best.join(rated, ["query_id", "_try"])
    return tries.join(chosen, ["query_id", "_try"]).select("query_id", "doc_id", "pick", "strategy", "k", "quality")


def newest_active(models: DataFrame) -> DataFrame:
    """Adds is_active to (model_id, created_at, ...): true for the one made last, ties to the larger id."""
    last = models.agg(F.max(F.struct("created_at", "model_id"))["model_id"].alias("_last"))
    return models.crossJoin(F.broadcast(last)).withColumn("is_active", F.col("model_id") == F.col("_last")).drop("_last")
