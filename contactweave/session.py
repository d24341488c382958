"""Session builder and table access shared by the queries, the CLI and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: As-of time of the synthetic tables; reports take it as a parameter instead of now().
AS_OF = "2025-06-30 12:00:00"


def build_session(app: str = "contactweave", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """Local session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CONTACTWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in spark.checkpoint.dir.

    A folder of this machine is taken only where none is named and everything runs in one process
    (tests, bench); on a cluster other executors couldn't read it, so there the setting must be given.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="contactweave-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory; column pruning and filters reach this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a reference list for the driver, refused when the list outgrows `limit`.

    Reference lists (towns, countries, residue exemplars, evaluation items) are shipped to
    the executors; this check is the proof that what is shipped stays small.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} holds more than {limit} rows; raise the bound or join it as a table")
    return rows
