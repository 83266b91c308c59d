"""Streams of measurements and feedback: windowed rates and means, alerts with a cooldown, deduplicated feedback, counts of late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

COOLDOWN_SECONDS = 3600


def windowed(stream: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(start, monitor, n, error_rate, latency) by window from (ts, monitor, failed, value); rows later than the watermark are dropped."""
    per = stream.withWatermark("ts", watermark).groupBy(F.window("ts", size), "monitor")
    found = per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("double")).alias("error_rate"), F.avg(F.when(~F.col("failed"), F.col("value"))).alias("latency"))
    return found.select(F.col("window.start").alias("start"), "monitor", "n", "error_rate", "latency")


def sessions(stream: DataFrame, watermark: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions by a gap."""
    per = stream.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(stream: DataFrame, key: str = "feedback_id", watermark: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


#: The state store that states with timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Cooldown(StatefulProcessor):
    """Per type: when it last fired, and the alerts that the watermark has not passed yet.

    An alert waits, under a timer of its own time, until the watermark has passed it; so timers come in order of time whatever the order of
    arrival, and nothing is sorted. Alerts that the last fired one silences for certain are not kept. A type's state is cleared when its
    cooldown is over.
    """

    def __init__(self, seconds: int):
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getMapState("waiting", "ms long", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for batch in rows:
            for us in (batch["ts"].dropna().astype("datetime64[us]").astype("int64")).tolist():
                if last is not None and us < last + self.gap:
                    continue
                at = (us // 1000,)
                if not self.waiting.containsKey(at):
                    self.waiting.updateValue(at, (us,))
                    self.handle.registerTimer(at[0] + 1)  # rows of the same millisecond may still come
                elif us < self.waiting.getValue(at)[0]:
                    self.waiting.updateValue(at, (us,))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, fired = (expiredTimerInfo.getExpiryTimeInMs() - 1,), []
        last = self.last.get()[0] if self.last.exists() else None
        if self.waiting.containsKey(at):
            us = self.waiting.getValue(at)[0]
            self.waiting.removeKey(at)
            if last is None or us - last >= self.gap:
                self.last.update((us,))
                self.handle.registerTimer((us + self.gap) // 1000 + 2)
                fired, last = [us], us
        if last is not None and (last + self.gap) // 1000 < at[0]:
            self.last.clear()
        if fired:
            yield pd.DataFrame({"alert_type": pd.Series([key[0]], dtype=object), "ts": pd.Series(fired, dtype="int64").astype("datetime64[us]")})

    def close(self) -> None:
        pass


def cooled(alerts: DataFrame, seconds: int = COOLDOWN_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """(alert_type, ts): alerts of (alert_type, ts) that fire, `seconds` at least after the last fired one of their type.

    Alerts that come out of order, by up to the watermark, are taken in order; later ones are dropped; null times don't fire. A fired
    alert is given out once the watermark has passed it. Sets the session's state store to one that keeps timers.
    """
    alerts.sparkSession.conf.set(*STATE_STORE)
    keyed = alerts.where("alert_type is not null").select("alert_type", "ts").withWatermark("ts", watermark).groupBy("alert_type")
    return keyed.transformWithStateInPandas(Cooldown(seconds), "alert_type string, ts timestamp", "append", "eventTime")


def metric_means(stream: DataFrame, watermark: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(start, monitor, metric, n, mean) by window from (ts, monitor, metrics map<string,double>); null values of a metric don't count."""
    each = stream.withWatermark("ts", watermark).select("ts", "monitor", F.explode("metrics").alias("metric", "value")).where("value is not null")
    per = each.groupBy(F.window("ts", size), "monitor", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return per.select(F.col("window.start").alias("start"), "monitor", "metric", "n", "mean")


def counted(stream: DataFrame, key: str, name: str = "rows", watermark: str = "10 minutes") -> DataFrame:
    """The stream without rows that are later than the watermark or repeat a key within it, its rows observed before and after.

    The observations `<name>_read` and `<name>_kept`, and what the state drops as late, reach a RowCounts listener.
    """
    read = stream.observe(f"{name}_read", F.count(F.lit(1)).alias("n"))
    return read.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key]).observe(f"{name}_kept", F.count(F.lit(1)).alias("n"))


class RowCounts(StreamingQueryListener):
    """Per query name and batch: rows read, kept and late, of streams made by counted(). Add it by spark.streams.addListener."""

    def __init__(self, name: str = "rows"):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        progress = event.progress
        seen = {k: v["n"] for k, v in (progress.observedMetrics or {}).items()}
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.batches[(progress.name, progress.batchId)] = (seen.get(f"{self.name}_read", 0), seen.get(f"{self.name}_kept", 0), late)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        pass

    def written(self, spark: SparkSession, path: str) -> DataFrame:
        """(query, batch, n_read, n_kept, n_late), appended to a table in `path`."""
        rows = [(q, b, *counts) for (q, b), counts in sorted(self.batches.items(), key=str)]
        spark.createDataFrame(rows, "query string, batch long, n_read long, n_kept long, n_late long").write.mode("append").parquet(path)
        return spark.read.parquet(path)
