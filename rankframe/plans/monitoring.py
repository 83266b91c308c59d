"""Queries of monitoring, experiments and feedback over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators import monitoring as M
from rankframe.plans.common import registering, table
from rankframe.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error").withColumn("monitor", F.col("user_id") % 50)


@register("SELECT event_id, round(avg((event_type = 'error')::INT) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS error_rate FROM events")
def rolling_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of the last hundred measurements of each monitor."""
    return M.rolling_error_rate(_events(spark, sf_dir), F.col("failed"), "monitor").select("event_id", F.round("error_rate", 6).alias("error_rate"))


@register("SELECT event_id, monitor FROM (SELECT event_id, user_id % 50 AS monitor, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, L7."""
    return M.last_n(_events(spark, sf_dir), "monitor", 100).select("event_id", "monitor")


@register(
    """WITH e AS (SELECT user_id % 50 AS monitor, event_type = 'error' AS failed, value FROM events), t AS (SELECT monitor, count(*) AS total, sum(failed::INT)::BIGINT AS errors FROM e GROUP BY 1),
r AS (SELECT monitor, value, row_number() OVER (PARTITION BY monitor ORDER BY value) AS r, count(*) OVER (PARTITION BY monitor) AS n FROM e WHERE NOT failed AND value IS NOT NULL),
s AS (SELECT monitor, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, min(CASE WHEN r = floor(0.95 * n) + 1 THEN value END) AS p95 FROM r GROUP BY 1)
SELECT monitor, total, errors, round(errors::DOUBLE / total, 6) AS error_rate, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(p95, 6) AS p95 FROM t LEFT JOIN s USING (monitor)"""
)
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E19."""
    found = M.latency_report(_events(spark, sf_dir), F.col("failed"), "value", "monitor")
    return found.select("monitor", "total", "errors", *[F.round(c, 6).alias(c) for c in ("error_rate", "mean", "std", "min", "max", "p95")])


WINDOWS_SQL = "w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, user_id % 50 AS monitor, count(*) AS n, avg((event_type = 'error')::INT) AS error_rate, avg(CASE WHEN event_type <> 'error' THEN value END) AS latency FROM events GROUP BY ALL)"


def windowed(events: DataFrame) -> DataFrame:
    """(start, monitor, n, error_rate, latency) by five minutes; the same over a stream with a watermark."""
    per = events.groupBy(F.window("ts", "5 minutes"), "monitor").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("double")).alias("error_rate"), F.avg(F.when(~F.col("failed"), F.col("value"))).alias("latency"))
    return per.select(F.col("window.start").alias("start"), "monitor", "n", "error_rate", "latency")


@register(f"WITH {WINDOWS_SQL} SELECT floor(epoch(start))::BIGINT AS start, monitor, n, round(error_rate, 6) AS error_rate, round(latency, 6) AS latency FROM w")
def windowed_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 in batch."""
    return windowed(_events(spark, sf_dir)).select(F.unix_seconds("start").alias("start"), "monitor", "n", F.round("error_rate", 6).alias("error_rate"), F.round("latency", 6).alias("latency"))


@register(
    f"""WITH {WINDOWS_SQL}, b AS (SELECT user_id % 50 AS monitor, avg(value) AS baseline FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) >= 10),
j AS (SELECT w.*, baseline FROM w JOIN b USING (monitor)) SELECT floor(epoch(start))::BIGINT AS start, monitor, 'latency' AS alert_type FROM j WHERE latency > 1.5 * baseline UNION ALL SELECT floor(epoch(start))::BIGINT, monitor, 'error_rate' FROM j WHERE error_rate > 0.05"""
)
def degradation_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E20, J14, L2."""
    events = _events(spark, sf_dir)
    found = M.degraded(windowed(events), M.baseline(events, F.col("failed"), "value", "monitor"), "monitor", "latency")
    return found.select(F.unix_seconds("start").alias("start"), "monitor", "alert_type")


@register(
    """WITH RECURSIVE e AS (SELECT user_id % 50 AS monitor, ts FROM events WHERE event_type = 'error'), f AS (SELECT monitor, min(ts) AS ts FROM e GROUP BY 1 UNION ALL
SELECT f.monitor, (SELECT min(ts) FROM e WHERE e.monitor = f.monitor AND e.ts >= f.ts + INTERVAL 1 HOUR) FROM f WHERE f.ts IS NOT NULL) SELECT monitor, floor(epoch(ts))::BIGINT AS fired FROM f WHERE ts IS NOT NULL"""
)
def cooled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that raise an alert with an hour's cooldown."""
    return M.cooled(_events(spark, sf_dir).where("failed"), "monitor").select("monitor", F.unix_seconds("ts").alias("fired"))


@register(
    """WITH m AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, event_type AS metric, value FROM events),
s AS (SELECT metric, count(value) FILTER (variant = 'A') AS n_a, avg(value) FILTER (variant = 'A') AS mean_a, stddev_samp(value) FILTER (variant = 'A') AS sd_a, count(value) FILTER (variant = 'B') AS n_b, avg(value) FILTER (variant = 'B') AS mean_b, stddev_samp(value) FILTER (variant = 'B') AS sd_b FROM m GROUP BY 1),
t AS (SELECT *, abs(mean_a - mean_b) / sqrt(sd_a ** 2 / n_a + sd_b ** 2 / n_b) AS t FROM s WHERE n_a >= 10 AND n_b >= 10), z AS (SELECT *, 1.0 / (1.0 + 0.3275911 * t / sqrt(2.0)) AS k, t / sqrt(2.0) AS x FROM t),
p AS (SELECT *, 2 * (1 - 0.5 * (2.0 - (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-x * x))) AS p FROM z)
SELECT metric, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t, round(p, 6) AS p, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN CASE WHEN mean_a > mean_b THEN 'A' ELSE 'B' END ELSE 'tie' END AS winner, round(mean_a - mean_b, 6) AS difference, round((mean_a - mean_b) / mean_b * 100, 6) AS improvement FROM p"""
)
def experiment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10, E11."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), F.col("event_type").alias("metric"), "value")
    found = M.experiment(rows, "variant", "metric", "value")
    return found.select("metric", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "t", "p")], "significant", "winner", *[F.round(c, 6).alias(c) for c in ("difference", "improvement")])


@register("SELECT item_id, md5(item_id::VARCHAR) AS h FROM benchmark ORDER BY h LIMIT 25")
def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 queries without replacement."""
    return M.fixed_sample(table(spark, sf_dir, "benchmark"), F.col("item_id"), 25).select("item_id", F.md5(F.col("item_id").cast("string")).alias("h"))


ENTRIES_SQL = "en AS (SELECT d.source AS query, d.lang AS session_id, count(*) AS retrieved, sum(l.quality) AS relevant, sum(l.quality) + 1 AS marked FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL), pr AS (SELECT *, relevant::DOUBLE / retrieved AS precision, relevant::DOUBLE / marked AS recall FROM en)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy(F.col("source").alias("query"), F.col("lang").alias("session_id")).agg(F.count(F.lit(1)).alias("retrieved"), F.sum("quality").alias("relevant"), (F.sum("quality") + 1).alias("marked"))


@register(
    f"""WITH {ENTRIES_SQL}, m AS (SELECT query, session_id, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr),
b AS (SELECT query, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM m GROUP BY 1), l AS (SELECT query, session_id, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value, unnest([p, r, f]) AS baseline, unnest([0.1, 0.15, 0.12]) AS t FROM m JOIN b USING (query))
SELECT query, session_id, metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round((baseline - value) / baseline * 100, 4) AS drop_percentage FROM l WHERE value < baseline * (1 - t)"""
)
def metric_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: sessions whose precision, recall or F1 falls under the mean of their query by more than the thresholds."""
    precision, recall = F.col("relevant") / F.col("retrieved"), F.col("relevant") / F.col("marked")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    measured = _entries(spark, sf_dir).select("query", "session_id", precision.alias("precision"), recall.alias("recall")).withColumn("f1", f1)
    base = measured.groupBy("query").agg(*[F.avg(m).alias(m) for m in M.THRESHOLDS])
    found = M.metric_drops(measured, base, "query")
    return found.select("query", "session_id", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), F.round("drop_percentage", 4).alias("drop_percentage"))


@register(f"WITH {ENTRIES_SQL} SELECT count(*) AS n, count(DISTINCT session_id) AS n_sessions, count(DISTINCT query) AS n_queries, round(avg(relevant), 6) AS mean_relevant, round(avg(precision), 6) AS mean_precision, round(stddev_samp(precision), 6) AS std_precision, round(avg(recall), 6) AS mean_recall, round(stddev_samp(recall), 6) AS std_recall, CASE WHEN avg(precision) < 0.6 THEN 12 ELSE 10 END AS top_k, avg(precision) < 0.6 AND count(*) >= 50 AS retrain FROM pr")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13, E17."""
    found = M.feedback_summary(_entries(spark, sf_dir))
    rounded = found.select("n", "n_sessions", "n_queries", *[F.round(c, 6).alias(c) for c in found.columns[3:]])
    return rounded.crossJoin(M.adaptive_parameters(rounded))


@register(f"WITH {ENTRIES_SQL} SELECT CASE WHEN session_id IN ('en') THEN 'safety' WHEN session_id = 'de' THEN 'dosing' ELSE 'general' END AS category, count(*) AS n, round(avg(precision), 6) AS mean_precision, round(coalesce(stddev_samp(precision), 0), 6) AS std_precision, sum((precision < 0.3)::INT)::BIGINT AS n_low, sum((relevant = 0)::INT)::BIGINT AS n_zero FROM pr GROUP BY 1")
def feedback_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14, E15."""
    category = F.when(F.col("session_id") == "en", "safety").when(F.col("session_id") == "de", "dosing").otherwise("general")
    found = M.feedback_patterns(_entries(spark, sf_dir), category)
    return found.select("category", "n", F.round("mean_precision", 6).alias("mean_precision"), F.round("std_precision", 6).alias("std_precision"), "n_low", "n_zero")


@register("SELECT count(*) AS n, round(avg(value), 6) AS mean_alpha, round(stddev_samp(value), 6) AS std_alpha, round(coalesce(corr(value, event_id), 0), 6) AS correlation FROM events")
def alpha_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and correlation of a logged value."""
    e = table(spark, sf_dir, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_alpha"), F.round(F.stddev_samp("value"), 6).alias("std_alpha"), F.round(F.coalesce(F.corr("value", "event_id"), F.lit(0.0)), 6).alias("correlation"))


@register("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5."""
    return M.recent(table(spark, sf_dir, "events"), "2024-01-15 00:00:00", 7).select("event_id")


@register(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM k GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 in batch: sessions with a gap of half an hour."""
    per = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


@register(
    f"""WITH {ENTRIES_SQL}, en2 AS (SELECT query || '/' || session_id AS query, session_id, retrieved, CASE WHEN length(query) % 2 = 0 THEN relevant ELSE relevant // 4 END AS relevant FROM en), f AS (SELECT query, session_id, relevant::DOUBLE / retrieved AS precision, unnest(list_filter([CASE WHEN relevant::DOUBLE / retrieved < 0.3 THEN 'low_precision' END, CASE WHEN relevant = 0 THEN 'zero_relevant' END], lambda x: x IS NOT NULL)) AS pattern FROM en2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY query, session_id) AS example, count(*) OVER (PARTITION BY pattern) AS n FROM f) SELECT pattern, n, example, query, round(precision, 6) AS precision FROM r WHERE example <= 5"""
)
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of failure with five examples each; every second query's relevant hits are quartered, so that both kinds are met."""
    entries = _entries(spark, sf_dir).where("session_id is not null").withColumn("relevant", F.when(F.length("query") % 2 == 0, F.col("relevant")).otherwise(F.floor(F.col("relevant") / 4)))
    found = M.failure_examples(entries.withColumn("query", F.concat_ws("/", "query", "session_id")))
    return found.select("pattern", "n", F.col("example").cast("long").alias("example"), "query", F.round("precision", 6).alias("precision"))


@register(
    f"""WITH {ENTRIES_SQL}, p AS (SELECT CASE session_id WHEN 'en' THEN 'safety' WHEN 'de' THEN 'dosing' ELSE 'general' END AS category, precision / k AS precision, k FROM pr, (VALUES (1), (2), (4)) v(k)),
m AS (SELECT k, avg(precision) AS every, avg(precision) FILTER (category = 'safety') AS safety, avg(precision) FILTER (category = 'dosing') AS dosing FROM p GROUP BY k)
SELECT k::BIGINT AS scale, CASE WHEN every < 0.4 THEN 12 ELSE 10 END::BIGINT AS top_k, CASE WHEN dosing < 0.5 THEN 'dosage,administration,pediatric' WHEN safety < 0.5 THEN 'warning,adverse,contraindication,safety' ELSE '' END AS sections, ((every < 0.4)::INT + coalesce(safety < 0.5, FALSE)::INT + coalesce(dosing < 0.5, FALSE)::INT)::BIGINT AS applied FROM m"""
)
def adapted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits to fetch and sections to prefer by the feedback as it is, and with its precision halved and quartered."""
    out = None
    for k in (1, 2, 4):
        entries = _entries(spark, sf_dir).withColumn("relevant", F.col("relevant") / k)
        category = F.when(F.col("session_id") == "en", "safety").when(F.col("session_id") == "de", "dosing").otherwise("general")
        one = M.adapted(M.feedback_patterns(entries, category), M.feedback_summary(entries)).select(F.lit(k).cast("long").alias("scale"), F.col("top_k").cast("long").alias("top_k"), "sections", F.col("applied").cast("long").alias("applied"))
        out = one if out is None else out.unionByName(one)
    return out


@register(
    f"""WITH {ENTRIES_SQL}, m AS (SELECT query, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, (retrieved % 10) / 10.0 AS alpha FROM pr)
SELECT count(*) AS n, round(avg(alpha), 6) AS mean_alpha, round(stddev_samp(alpha), 6) AS std_alpha, round(avg(f1), 6) AS mean_f1, round(coalesce(corr(alpha, f1), 0), 6) AS correlation FROM m"""
)
def alpha_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the weight of each session goes with its F1; the weight is a fixture."""
    precision, recall = F.col("relevant") / F.col("retrieved"), F.col("relevant") / F.col("marked")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    found = M.alpha_performance(_entries(spark, sf_dir).select(((F.col("retrieved") % 10) / 10.0).alias("alpha"), f1.alias("f1")))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean_alpha", "std_alpha", "mean_f1", "correlation")])


@register(
    """SELECT user_id % 50 AS monitor, count(*) AS total, sum((event_type = 'error')::INT)::BIGINT AS errors, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean, TRUE AS quantile_near, TRUE AS users_near FROM events WHERE ts < TIMESTAMP '2030-01-01' GROUP BY 1"""
)
def sketched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13, E19 by sketches of each day, merged: exact counts and means; whether the estimated p95 stands within 2.5% of
    the exact rank, and the number of users within 5% (or one) of the exact one."""
    events = _events(spark, sf_dir)
    days = written(M.sketched(events, F.col("failed"), "value", "ts", "monitor", "user_id"), "days")
    found = M.merged_report(days, "monitor")
    x = F.when(~F.col("failed"), F.col("value"))
    exact = events.join(found.select("monitor", "quantile"), "monitor").groupBy("monitor").agg(F.avg((x <= F.col("quantile")).cast("double")).alias("_upto"), F.avg((x < F.col("quantile")).cast("double")).alias("_under"), F.count_distinct("user_id").alias("_u"))
    near = (F.col("_upto") >= 0.925) & (F.col("_under") <= 0.975)
    close = F.abs(F.col("n_users") - F.col("_u")) <= F.greatest(F.lit(1), 0.05 * F.col("_u"))
    return found.join(exact, "monitor").select("monitor", "total", "errors", F.round("mean", 6).alias("mean"), F.coalesce(near, F.lit(True)).alias("quantile_near"), close.alias("users_near"))
