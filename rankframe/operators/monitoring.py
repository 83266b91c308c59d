"""Monitoring, experiments and relevance feedback over logs of measurements. Points in time are parameters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coefficients of the polynomial for the normal distribution's integral.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
#: The share of its baseline by which each metric may drop.
THRESHOLDS = {"precision": 0.1, "recall": 0.15, "f1": 0.12}


def recent(rows: DataFrame, as_of: str | Column, days: int, ts: str = "ts") -> DataFrame:
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return rows.where((F.col(ts) > at - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= at))


def rolling_error_rate(rows: DataFrame, failed: Column, key: str, last: int = 100, order: Sequence[str] = ("ts", "event_id"), unit: str = "day") -> DataFrame:
    """Adds error_rate: the share of failures among the last `last` rows of the key, in the given order, of which the first is a time.

    A key's rows are taken by stretches of time (`unit`), each led by as many of the rows before it as its first rows look back on; so a
    hot key is many windows. Counts by key and stretch tell which stretches these are. Rows without a time come first.
    """
    stretch = F.coalesce(F.date_trunc(unit, F.col(order[0]).cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))
    tagged = rows.withColumn("_failed", failed.cast("double")).withColumn("_b", stretch)
    counts = tagged.groupBy(F.col(key).alias("_key"), "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key").orderBy("_b")))
    later = counts.select(F.col("_key").alias("_key2"), F.col("_b").alias("_to"), (F.col("_upto") - F.col("_n")).alias("_before"))
    leads = counts.join(later, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_b") < F.col("_to")) & (F.col("_before") - F.col("_upto") < last - 1)).select("_key", F.col("_b").alias("_from"), "_to")
    back = Window.partitionBy(key, "_b").orderBy(*[F.desc(c) for c in order])
    tails = tagged.withColumn("_r", F.row_number().over(back)).where(F.col("_r") < last).drop("_r")
    ahead = tails.join(leads, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_from"))).drop("_key", "_from", "_b").withColumnRenamed("_to", "_b")
    both = tagged.withColumn("_own", F.lit(True)).unionByName(ahead.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(-(last - 1), 0)
    return both.withColumn("error_rate", F.avg("_failed").over(w)).where("_own").select(*rows.columns, "error_rate")


def last_n(rows: DataFrame, key: str, n: int = 1000, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= n).drop("_r")


def cooled(alerts: DataFrame, key: str, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """(key, ts): the alerts that fire, at least `seconds` after the last fired one of their key.

    The first alert after a gap of `seconds` always fires, so a key's alerts are cut at such gaps into runs, found from the first and
    last alert of each stretch of that length. Each run is read once in order, with one number held; a hot key is as many runs as
    it has gaps. Null times and keys don't fire.
    """
    length = seconds * 1_000_000
    rows = alerts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).withColumn("b", F.floor(F.col("at") / F.lit(length)))
    spans = rows.groupBy("k", "b").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    order = Window.partitionBy("k").orderBy("b")
    spans = spans.withColumn("new", F.coalesce((F.col("low") - F.lag("high").over(order) >= length).cast("long"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    kind = rows.schema["k"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, 0
        for batch in batches:
            held = list(zip(batch.column("k").to_pylist(), batch.column("run").to_pylist(), strict=True))
            fired = []
            for place, (now, at) in enumerate(zip(held, batch.column("at").to_pylist(), strict=True)):
                if now != of or at - last >= length:
                    fired.append(place)
                    of, last = now, at
            some = batch.take(pa.array(fired, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("k"), some.column("at")], names=["k", "at"])

    runs = rows.join(spans.select("k", "b", "run"), ["k", "b"]).repartition("k", "run").sortWithinPartitions("k", "run", "at")
    found = runs.select("k", "run", "at").mapInArrow(fold, T.StructType().add("k", kind).add("at", "long"))
    return found.select(F.col("k").alias(key), F.timestamp_micros("at").alias(ts))


def metric_drops(measured: DataFrame, base: DataFrame, key: str, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """The rows of measured (key and the metrics) that fall under their baseline (key and the metrics) by more than the threshold's share.

    Adds metric, value, baseline and drop_percentage; a row may drop in several metrics.
    """
    both = measured.join(base.select(F.col(key).alias("_of"), *[F.col(m).alias(f"_base_{m}") for m in thresholds]), F.col(key) == F.col("_of"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"_base_{m}").alias("baseline"), F.lit(float(t)).alias("t")) for m, t in thresholds.items()])
    rows = both.withColumn("x", F.explode(each)).where("x.value < x.baseline * (1 - x.t)")
    drop = (F.col("x.baseline") - F.col("x.value")) / F.col("x.baseline") * 100
    return rows.select(*measured.columns, "x.metric", "x.value", "x.baseline", drop.alias("drop_percentage"))


def latency_report(rows: DataFrame, failed: Column, value: str, key: str) -> DataFrame:
    """(key, total, errors, error_rate, mean, std, min, max, p95): over successes; std is of the sample, p95 the value at floor(.95 n)."""
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.sum(failed.cast("long")).alias("errors"))
    good = rows.where(~failed & F.col(value).isNotNull())
    w = Window.partitionBy(key)
    ranked = good.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    stats = ranked.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.min(F.when(F.col("_r") == F.floor(0.95 * F.col("_n")) + 1, F.col(value))).alias("p95"))
    return totals.join(stats, key, "left").withColumn("error_rate", F.col("errors") / F.col("total"))


def baseline(rows: DataFrame, failed: Column, value: str, key: str, least: int = 10) -> DataFrame:
    """(key, baseline, n): means over successes of keys with enough of them."""
    return rows.where(~failed).groupBy(key).agg(F.avg(value).alias("baseline"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def degraded(rates: DataFrame, base: DataFrame, key: str, latency: str, factor: float = 1.5, most_errors: float = 0.05) -> DataFrame:
    """The rows of rates (key, latency, error_rate) that break a bound against their baseline, with alert_type."""
    both = rates.join(base.select(key, "baseline"), key)
    slow, bad = F.col(latency) > factor * F.col("baseline"), F.col("error_rate") > most_errors
    return both.withColumn("alert_type", F.explode(F.array_compact(F.array(F.when(slow, "latency"), F.when(bad, "error_rate")))))


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    y = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.signum(x) * y)


def experiment(rows: DataFrame, variant: str, metric: str, value: str, pair: tuple[str, str] = ("A", "B"), least: int = 10, alpha: float = 0.05) -> DataFrame:
    """(metric, n_a, n_b, mean_a, mean_b, t, p, significant, winner, difference, improvement): Welch's error and a normal p-value."""
    a, b = pair
    stats = rows.where(F.col(variant).isin(a, b)).groupBy(metric).agg(*[f(F.when(F.col(variant) == v, F.col(value))).alias(f"{name}_{s}") for v, s in ((a, "a"), (b, "b")) for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))])
    se = F.sqrt(F.pow("sd_a", F.lit(2)) / F.col("n_a") + F.pow("sd_b", F.lit(2)) / F.col("n_b"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least) & (se > 0)
    out = stats.withColumn("t", F.when(enough, F.abs(F.col("mean_a") - F.col("mean_b")) / se)).withColumn("p", F.when(enough, 2 * (1 - normal_cdf(F.col("t")))))
    out = out.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False))).withColumn("difference", F.col("mean_a") - F.col("mean_b"))
    winner = F.when(F.col("significant"), F.when(F.col("difference") > 0, a).otherwise(b)).otherwise("tie")
    return out.withColumn("winner", winner).withColumn("improvement", F.when(F.col("mean_b") != 0, F.col("difference") / F.col("mean_b") * 100).otherwise(0.0)).drop("sd_a", "sd_b")


def fixed_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows, chosen by the md5 of the key."""
    return rows.withColumn("_h", F.md5(key.cast("string"))).orderBy("_h").limit(n).drop("_h")


def feedback_summary(entries: DataFrame) -> DataFrame:
    """One row from (feedback_id, query, session_id, retrieved, relevant, marked): sessions, queries, means and sample deviations."""
    rows = entries.withColumn("precision", F.when(F.col("retrieved") > 0, F.col("relevant") / F.col("retrieved")).otherwise(0.0)).withColumn("recall", F.when(F.col("marked") > 0, F.col("relevant") / F.col("marked")).otherwise(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("query").alias("n_queries"), F.avg("relevant").alias("mean_relevant"),
        F.avg("precision").alias("mean_precision"), F.stddev_samp("precision").alias("std_precision"), F.avg("recall").alias("mean_recall"), F.stddev_samp("recall").alias("std_recall"),
    )


def feedback_patterns(entries: DataFrame, category: Column) -> DataFrame:
    """(category, n, mean_precision, std_precision, n_low, n_zero): failures are precision under .3 and no relevant hit."""
    rows = entries.withColumn("category", category).withColumn("precision", F.when(F.col("retrieved") > 0, F.col("relevant") / F.col("retrieved")).otherwise(0.0))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("precision").alias("mean_precision"), F.coalesce(F.stddev_samp("precision"), F.lit(0.0)).alias("std_precision"), F.sum((F.col("precision") < 0.3).cast("long")).alias("n_low"), F.sum((F.col("relevant") == 0).cast("long")).alias("n_zero"))


def failure_examples(entries: DataFrame, order: Sequence[str] = ("query", "session_id"), most: int = 5) -> DataFrame:
    """(pattern, n, example, query, precision): low_precision (under .3 of what was retrieved) and zero_relevant, with how many entries
    fail so and the first `most` of them in order. Entries that retrieved nothing have no precision."""
    precision = F.when(F.col("retrieved") > 0, F.col("relevant") / F.col("retrieved"))
    named = F.array_compact(F.array(F.when(precision < 0.3, "low_precision"), F.when(F.col("relevant") == 0, "zero_relevant")))
    rows = entries.select(*order, precision.alias("precision"), F.explode(named).alias("pattern"))
    totals = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("example", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).where(F.col("example") <= most)
    return first.join(totals, "pattern").select("pattern", "n", "example", "query", "precision")


#: Under which mean precision of which category (null: of all) a parameter changes.
IMPROVEMENTS = ((None, 0.4, "top_k", ""), ("safety", 0.5, "sections", "warning,adverse,contraindication,safety"), ("dosing", 0.5, "sections", "dosage,administration,pediatric"))


def adapted(patterns: DataFrame, summary: DataFrame, top_k: int = 10, sections: str = "", rules: Sequence[tuple[str | None, float, str, str]] = IMPROVEMENTS) -> DataFrame:
    """One row: top_k and sections as the rules change them, in order, a later one of the same parameter overriding; and applied, how many hold.

    patterns: feedback_patterns by category; summary: one row with mean_precision. A category without feedback changes nothing.
    """
    means = patterns.agg(*[F.min(F.when(F.col("category") == c, F.col("mean_precision"))).alias(f"_{c}") for c, *_ in rules if c])
    rows = summary.select(F.coalesce("mean_precision", F.lit(0.0)).alias("_all")).crossJoin(F.broadcast(means))  # one row and one row
    k, named, applied = F.lit(top_k), F.lit(sections), F.lit(0)
    for category, under, parameter, value in rules:
        holds = F.coalesce(F.col(f"_{category}" if category else "_all") < under, F.lit(False))
        applied = applied + holds.cast("int")
        if parameter == "top_k":
            k = F.when(holds, F.least(k + 2, F.lit(15))).otherwise(k)
        else:
            named = F.when(holds, F.lit(value)).otherwise(named)
    return rows.select(k.alias("top_k"), named.alias("sections"), applied.alias("applied"))


def sketched(rows: DataFrame, failed: Column, value: str, at: str, key: str, distinct: str) -> DataFrame:
    """(key, day, total, errors, n, sum, values, users): what a day of a key leaves behind to be merged for any span.

    values is a quantile sketch of the successes' values, users a distinct sketch of the column `distinct`; both are bounded in size,
    so a hot key is summed in every task and never sorted.
    """
    good = ~failed & F.col(value).isNotNull()
    return rows.groupBy(key, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(failed.cast("long")).alias("errors"), F.sum(good.cast("long")).alias("n"), F.sum(F.when(good, F.col(value))).alias("sum"),
        F.kll_sketch_agg_double(F.when(good, F.col(value)), F.lit(SKETCH)).alias("values"), F.hll_sketch_agg(distinct).alias("users"),
    )


def alpha_performance(rows: DataFrame, alpha: str = "alpha", value: str = "f1") -> DataFrame:
    """One row: n, mean_alpha, std_alpha (of the sample), mean_f1 and their Pearson correlation, 0 where it isn't defined."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(alpha).alias("mean_alpha"), F.stddev_samp(alpha).alias("std_alpha"), F.avg(value).alias("mean_f1"), F.corr(alpha, value).alias("c"))
    return found.withColumn("correlation", F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))).drop("c")


#: Size of the quantile sketches: ranks are within about 0.7% of the exact ones.
SKETCH = 400


def merged_report(days: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """(key, total, errors, error_rate, mean, quantile, n_users) over the days given: counts and means exact, the quantile and the
    number of users estimated."""
    both = days.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("total", "errors", "n", "sum")], F.kll_merge_agg_double("values").alias("_values"), F.hll_union_agg("users").alias("_users"))
    return both.select(
        key, "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"), (F.col("sum") / F.nullif("n", F.lit(0))).alias("mean"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_values", F.lit(share))).alias("quantile"), F.hll_sketch_estimate("_users").alias("n_users"),
    )


def recommendations(patterns: DataFrame, rules: Mapping[str, str], least: float = 0.5) -> DataFrame:
    """(category, advice) for categories whose mean precision is under `least`."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else F.lit(None)
    return patterns.where(F.col("mean_precision") < least).select("category", F.coalesce(F.element_at(table, F.col("category")), F.lit("review the ranking")).alias("advice"))


def adaptive_parameters(summary: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: top_k, raised by 2 to 15 at most where the mean precision is under .6, and whether to retrain (50 queries and that)."""
    low = F.col("mean_precision") < 0.6
    return summary.select(F.when(low, F.least(F.lit(top_k + 2), F.lit(15))).otherwise(top_k).alias("top_k"), (low & (F.col("n") >= 50)).alias("retrain"))
