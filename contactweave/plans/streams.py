"""Queries of the streaming forms: each drains the table as a stream, with watermark and state, into its report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.plans.registry import Registry
from contactweave.session import ensure_checkpoint_dir, table
from contactweave.streaming import jobs

R = Registry()


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream of the table's schema; times get a zone, which watermarks need."""
    df = table(spark, sf_dir, name)
    s = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/{name}[.]parquet")  # a pattern, as the table may be a file or a folder
    return s.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in s.dtypes])


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The stream's result after all that is there, written to the folder the executors share and read back."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/streams-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(f"{base}/rows")
    return done.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in done.dtypes])


@R.add(
    "stream_hourly",
    """SELECT date_trunc('hour', updated_at) AS hour, count(*) AS rows_processed, count(*) FILTER (WHERE scrape_status = 'success') AS success_count, CAST(sum(emails_count) AS BIGINT) AS emails_found
 FROM zen_contacts WHERE updated_at IS NOT NULL GROUP BY 1""",
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "zen_contacts").select("updated_at", "scrape_status", "emails_count")
    return _drained(jobs.hourly(s), "stream_hourly", "complete")


@R.add(
    "stream_rates",
    """SELECT "at", server, least(n / 3.0::DOUBLE, 1000.0::DOUBLE) AS per_minute FROM (SELECT "at", server, count(*) AS n FROM (SELECT last_scrape_server AS server,
 unnest(generate_series(time_bucket(INTERVAL 30 SECOND, updated_at) + INTERVAL 30 SECOND, time_bucket(INTERVAL 30 SECOND, updated_at) + INTERVAL 180 SECOND, INTERVAL 30 SECOND)) AS "at"
 FROM zen_contacts WHERE updated_at IS NOT NULL AND last_scrape_server IS NOT NULL) GROUP BY 1, 2)""",
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "zen_contacts").select("updated_at", F.col("last_scrape_server").alias("server")).filter("server IS NOT NULL")
    return _drained(jobs.rolling_rate(s, "updated_at", "server"), "stream_rates", "complete")


@R.add(
    "stream_servers",
    "SELECT server_id, max(last_heartbeat) AS last_heartbeat, arg_max(status, last_heartbeat) FILTER (WHERE status IS NOT NULL) AS status, arg_max(current_task, last_heartbeat) FILTER (WHERE current_task IS NOT NULL) AS current_task FROM zen_servers GROUP BY 1",
)
def stream_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "zen_servers").select("server_id", "last_heartbeat", "status", "current_task")
    return _drained(jobs.latest_heartbeats(s), "stream_servers", "complete")


@R.add("stream_distinct", "SELECT DISTINCT source_link FROM zen_contacts WHERE source_link IS NOT NULL AND updated_at IS NOT NULL")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without repeats inside the watermark; everything arrives in one trigger here."""
    s = _stream(spark, sf_dir, "zen_contacts").select("source_link", "updated_at").filter("source_link IS NOT NULL AND updated_at IS NOT NULL")
    return _drained(jobs.without_repeats(s, "updated_at", ["source_link"], "3650 days"), "stream_distinct", "append").select("source_link")
