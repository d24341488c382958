"""Structured Streaming forms: folder intake, windowed figures with late data, heartbeats, smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def listing_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 3) -> DataFrame:
    """New CSV files of a folder, a few per trigger; files seen before are never read again.

    Producers write elsewhere and move finished files in, so no file is read while it grows.
    """
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )


def hourly(stream: DataFrame, ts: str = "updated_at", late: str = "2 days") -> DataFrame:
    """Tumbling hours; rows later than `late` are past the watermark."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"))
        .agg(F.count("*").alias("rows_processed"), F.count(F.when(F.col("scrape_status") == "success", 1)).alias("success_count"), F.sum("emails_count").alias("emails_found"))
        .select(F.col("window.start").alias("hour"), "rows_processed", "success_count", "emails_found")
    )


def rolling_rate(stream: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Completions a minute per key in sliding windows of 3 minutes every 30 seconds."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, "3 minutes", "30 seconds"), key).agg(F.count("*").alias("n"))
        .select(F.col("window.end").alias("at"), key, F.least(F.col("n") / 3.0, F.lit(1000.0)).alias("per_minute"))
    )


def without_repeats(stream: DataFrame, ts: str, keys: list[str], within: str = "1 second") -> DataFrame:
    """Messages without repeats of the same keys inside the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def latest_heartbeats(stream: DataFrame, key: str = "server_id", ts: str = "last_heartbeat") -> DataFrame:
    """Latest state per server: last non-null status and task, newest heartbeat (update or complete mode)."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c)
    return stream.groupBy(key).agg(F.max(ts).alias(ts), newest("status"), newest("current_task"))


def server_health(stream: DataFrame, key: str = "server_id", ts: str = "last_heartbeat", late: str = "1 minute", silent: str = "5 minutes") -> DataFrame:
    """A row per server and change of health: healthy or warning with its heartbeats, critical when it falls silent.

    A heartbeat more than two minutes behind the watermark is a warning. A server that sends nothing for `silent` of event
    time is reported critical once and forgotten, so the state never outgrows the servers that are alive.
    """
    limit_ms = int(pd.Timedelta(silent).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0], unit="ms")
            state.remove()
            yield pd.DataFrame({key: [k[0]], ts: [last], "health": ["critical"]})
            return
        newest = max(b[ts].max() for b in batches)
        at = int(newest.timestamp() * 1000)
        before = state.get if state.exists else (0, "")
        mark = state.getCurrentWatermarkMs()
        health = "warning" if mark and mark - at > 120_000 else "healthy"
        at = max(at, before[0])
        state.update((at, health))
        state.setTimeoutTimestamp(max(at, mark + 1) + limit_ms)
        if health != before[1]:
            yield pd.DataFrame({key: [k[0]], ts: [newest], "health": [health]})

    kind = dict(stream.dtypes)[key]
    return (
        stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(key)
        .applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp, health string", "at long, health string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def refreshed(stream: DataFrame, report, path: str, checkpoint: str, every: str = "5 minutes"):
    """Start a query that rewrites the report at `path` after each trigger that brought rows; `report()` gives its frame."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report().coalesce(1).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def smoothed(stream: DataFrame, key: str, value: str, ts: str, alpha: float = 0.2) -> DataFrame:
    """Moving average per key as rows arrive, ordered by time within a trigger; one number of state per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for v in rows[value]:
            s = float(v) if s is None else alpha * float(v) + (1 - alpha) * s
            out.append(s)
        state.update((s,))
        yield pd.DataFrame({key: [k[0]] * len(out), ts: rows[ts].tolist(), "smoothed": out})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, smoothed double", "s double", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a memory table (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
