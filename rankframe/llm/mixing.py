"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a piecewise-linear weight schedule over training time 0..1. Its integral up to t, scaled to the source's
target, is the number of its tokens that training has asked for by t. A document's tokens stand at a place in its
source's own order, once for each pass over the source; the time at which demand reaches that place is the training position
of the document in that pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating, null last.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its words.
MOST_REPEATS = 3
#: Times at which the schedules are given, and the schedules, dealt to the sources in the same order as the weights.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: About how many documents share a bucket of the prefix sums.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, ordinal, n_docs, source_size, target): water-filling of the whole size by weight under the cap.

    A source is capped if its cap per weight lies below the level that remains for it and all sources of larger
    cap per weight. One row per source goes through the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("w", dealt(F.col("ordinal"), weights)).withColumn("cap", most * F.col("source_size").cast("double"))
    ascending = Window.orderBy(F.col("cap") / F.col("w"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(ascending), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ascending), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") < F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "ordinal", "level"))).over(whole)["level"]
    return per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", final * F.col("w")))).select("source", "ordinal", "n_docs", "source_size", "target")


def dealt(ordinal: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (ordinal % len(values) + 1).cast("int"))


def demand_inverse(share: Column, ordinal: Column, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time by which `share` (0..1) of a source's tokens has been asked for: its integrated schedule, inverted."""
    if len(knots) < 2 or list(knots) != sorted(set(knots)) or any(len(s) != len(knots) or min(s) < 0 or sum(s) <= 0 for s in schedules):
        raise ValueError("schedules need a weight of 0 or more at each of at least two rising knots")
    by_schedule = F.lit(None).cast("double")
    for k, weights in enumerate(schedules):
        areas = [(knots[i + 1] - knots[i]) * (weights[i] + weights[i + 1]) / 2 for i in range(len(knots) - 1)]
        wanted, time, done = share * sum(areas), F.lit(float(knots[-1])), sum(areas)
        for i in reversed(range(len(areas))):
            done -= areas[i]
            if not areas[i]:
                continue
            slope = (weights[i + 1] - weights[i]) / (knots[i + 1] - knots[i])
            rest = F.greatest(wanted - done, F.lit(0.0))
            inside = rest / weights[i] if not slope else (F.sqrt(F.greatest(F.lit(0.0), weights[i] ** 2 + 2 * slope * rest)) - weights[i]) / slope
            time = F.when(wanted <= done + areas[i], knots[i] + inside).otherwise(time)
        by_schedule = F.when(ordinal % len(schedules) == k, time).otherwise(by_schedule)
    return by_schedule


def placed(docs: DataFrame, weights: Sequence[float], most: float, bucket_rows: int, keep: Sequence[str]) -> DataFrame:
    """Every row of docs as the struct `doc` (the columns named in keep) beside its size, the facts of its source (source_size,
    target, ordinal, quota, passes, rest) and `before`: the words of its source that stand ahead of it in one pass.

    A source's rows stand in the order of a hash of id and text. Prefix sums go over buckets of the hash; rows that share
    one hash (the same id and text, whose order among each other changes nothing) are dealt over salts where they are many.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text))
    rows = docs.select("source", size.alias("size"), h.alias("h"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))), "sizes")
    sources = source_targets(rows, weights, most)
    sources = sources.withColumn("quota", F.floor(F.col("target") + 0.5)).withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(bucket_rows)).cast("long"))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    # written, so that its size is known: a small table of sources is broadcast, a large one is not
    rows = rows.join(written(sources.withColumnRenamed("source", "_source"), "sources"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(1 << 32))))
    many = rows.groupBy("ordinal", F.col("h").alias("hot")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > bucket_rows)
    many = written(many.withColumnRenamed("ordinal", "_ordinal"), "repeated")  # at most one for every bucket_rows rows
    rows = rows.join(many, (F.col("ordinal") == F.col("_ordinal")) & (F.col("h") == F.col("hot")), "left").drop("_ordinal")
    rows = rows.withColumn("hot", F.coalesce("hot", F.lit(""))).withColumn("part", F.when(F.col("hot") != "", F.pmod(F.col("salt"), F.ceil(F.col("copies") / F.lit(bucket_rows)).cast("long"))).otherwise(F.lit(0).cast("long")))
    ahead = rows.groupBy("ordinal", "bucket", "hot", "part").agg(F.sum("size").alias("held"))
    ahead = ahead.withColumn("offset", F.coalesce(F.sum("held").over(Window.partitionBy("ordinal").orderBy("bucket", "hot", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("ordinal", "bucket", "hot", "part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ahead.drop("held"), ["ordinal", "bucket", "hot", "part"]).withColumn("before", F.col("offset") + F.col("inside"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.withColumn("extra", extra).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))


def _position(turn: Column, knots: Sequence[float], schedules: Sequence[Sequence[float]]) -> Column:
    """The training time at which pass `turn` over the source reaches the document."""
    return demand_inverse((turn * F.col("source_size") + F.col("before")) / F.col("quota"), F.col("ordinal"), knots, schedules)


def _turns() -> Column:
    """How many passes take words of the document."""
    return F.when(F.col("size") > 0, F.col("passes") + (F.col("extra") > 0).cast("long")).otherwise(F.lit(0))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, position, last_position).

    The mix passes over a source's documents as often as the target asks: whole passes first, then the words that are
    left of the target from the front, so that one document of a source at most is cut. A source may hold any share of
    the rows, and so may rows that repeat. position is the training time of the first token that the mix takes of the document,
    last_position that of the last pass that takes any; both are null for a document that the mix leaves out. Null text has
    size 0, a null source is a source of its own, repeated rows and ids count each time, an empty table gives no rows. Rows
    come range-sorted by position. Sources pass through one task for their ranks, a row for each source.
    """
    rows = placed(docs, weights, most, bucket_rows, ["doc_id"])
    some = F.col("taken") > 0
    picked = rows.select(
        "doc.doc_id", "size", "source_size", "target", "taken", F.when(some, _position(F.lit(0), knots, schedules)).alias("position"),
        F.when(some, _position(_turns() - 1, knots, schedules)).alias("last_position"),
    )
    # what the mix leaves out stands behind the rest, spread by its hash so that it fills no single range
    behind = 1.0 + F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 20)) / float(1 << 20)
    return picked.repartitionByRange(F.coalesce("position", behind)).sortWithinPartitions(F.coalesce("position", behind), "doc_id")


def training_order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix itself, with the columns of docs (whatever their names): a row for each pass that takes words of a document.

    Rows are range-sorted by the position of their pass, so a document that the mix takes three times stands at three places. One
    that it leaves out, or that has no word, doesn't appear. Nulls, repeats and empty tables as in mixed_documents.
    """
    rows = placed(docs, weights, most, bucket_rows, docs.columns).where("taken > 0")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), _turns() - 1))).withColumn("at", _position(F.col("turn"), knots, schedules))
    return rows.repartitionByRange("at", "h").sortWithinPartitions("at", "h").select("doc.*")
