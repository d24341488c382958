"""Writers: processed listing files, markers, reports, partitioned contact tables, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.common import partition_key
from contactweave.operators.merging import upsert
from contactweave.operators.postprocess import OUTPUT_COLUMNS, SINGLE_COLUMNS


def write_listing(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    """Processed rows with the fixed header; `rows_per_file` starts new files."""
    w = df.select(*OUTPUT_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"')
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).csv(path)


def write_marker(df: DataFrame, path: str, expected: int | None = None) -> None:
    """One-row completion marker; the committer makes it appear whole or not at all."""
    n = F.count("*")
    status = F.when(n >= expected, "complete").otherwise("partial") if expected is not None else F.lit("complete")
    df.agg(status.alias("status"), n.alias("n_rows")).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> str:
    """The one-row report as JSON; returns it as text lines."""
    report.write.mode("overwrite").json(path)
    row = report.first()
    return "\n".join(f"{k}: {row[k]}" for k in report.columns)


def write_contacts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Contact table in 32 hash partitions; each is written by many tasks in ranges of the link, sorted for data skipping."""
    out = df.withColumn("partition_key", partition_key(F.col("source_link")))
    by = ("partition_key", "source_link")
    out.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy("partition_key").parquet(path)


def merge_into(spark: SparkSession, path: str, new: DataFrame, staged: str) -> None:
    """Merge `new` into the table at `path`, every column kept: only partitions that `new` touches are rewritten.

    The merged partitions are written to `staged` first, whole, and then swapped in by Spark's dynamic
    partition overwrite, whose committer moves them when all tasks are done. Reading and overwriting
    one path in a plan would lose data, hence the two steps.
    """
    old = spark.read.parquet(path)
    keyed = new.withColumn("partition_key", partition_key(F.col("source_link")))
    touched = [r[0] for r in keyed.filter("source_link IS NOT NULL").select("partition_key").distinct().collect()]  # at most PARTITIONS numbers
    write_contacts(upsert(old.filter(F.col("partition_key").isin(touched)), keyed), staged)
    merged = spark.read.parquet(staged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_key").parquet(path)


def write_parts(df: DataFrame, path: str, columns: Sequence[str], part: str = "part") -> None:
    """One folder per part with a header each."""
    df.select(part, *columns).repartition(part).write.mode("overwrite").partitionBy(part).option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A list of lines, rewritten whole or appended."""
    df.select("line").write.mode(mode).text(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_single(df: DataFrame, path: str) -> None:
    """Result of a single address: the thirteen columns of `SINGLE_COLUMNS`, one file."""
    df.select(*SINGLE_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
