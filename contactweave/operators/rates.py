"""Rolling rates over completion times, in time chunks so that no key becomes one task.

A trailing window reaches back a fixed time, so each chunk of a key needs only the rows of that time
before it: these are copied in as context and dropped after the window ran. Cumulative figures add the
counts of earlier chunks, of which there is one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RATE = 1000.0


def seconds_of(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("long")


def _chunked(df: DataFrame, key: str, sec: str, back: int, chunk: int) -> DataFrame:
    """Rows with `__chunk` and `__own`; rows near a chunk's end are context of the next one too."""
    at = F.floor(F.col(sec) / chunk).cast("long")
    late = (F.col(sec) + back) >= (at + 1) * chunk
    places = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
    return df.withColumn("__home", at).withColumn("__chunk", F.explode(places)).withColumn("__own", F.col("__chunk") == F.col("__home"))


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: int = 180, chunk: int = 86_400) -> DataFrame:
    """`n_recent`: rows of the key in the last `seconds` up to and with the row's own second.

    Rows with a null time are left out; `chunk` is the time one task's group may span.
    """
    if seconds > chunk:
        raise ValueError("the window must fit into a chunk")
    sec = df.filter(F.col(ts).isNotNull()).withColumn("__s", seconds_of(F.col(ts)))
    w = Window.partitionBy(key, "__chunk").orderBy("__s").rangeBetween(-seconds, 0)
    return (
        _chunked(sec, key, "__s", seconds, chunk).withColumn("n_recent", F.count("*").over(w)).withColumn("__first", F.min("__s").over(w))
        .filter("__own").withColumn("recent_span", F.col("__s") - F.col("__first")).drop("__s", "__home", "__chunk", "__own", "__first")
    )


def instant_rate(n_recent: Column, span: Column, fallback: Column) -> Column:
    """Completions a minute over the recent span, at least a second, at most 1000; one row alone takes the fallback."""
    per_minute = n_recent / F.greatest(span / F.lit(60.0), F.lit(1 / 60.0))
    return F.when(n_recent >= 2, F.least(per_minute, F.lit(MAX_RATE))).otherwise(fallback)


def cumulative_rates(df: DataFrame, key: str, ts: str, order: str, chunk: int = 86_400) -> DataFrame:
    """`n_done` so far per key (by time, then `order`) and `rate` per minute since the key's first row, at most 1000."""
    sec = df.filter(F.col(ts).isNotNull()).withColumn("__s", seconds_of(F.col(ts))).withColumn("__chunk", F.floor(F.col("__s") / chunk).cast("long"))
    per = sec.groupBy(key, "__chunk").agg(F.count("*").alias("__c"), F.min("__s").alias("__lo"))
    before = Window.partitionBy(key).orderBy("__chunk")
    per = per.select(
        key, "__chunk",
        F.coalesce(F.sum("__c").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.min("__lo").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("__start"),
    )
    here = F.row_number().over(Window.partitionBy(key, "__chunk").orderBy("__s", order))
    minutes = F.greatest((F.col("__s") - F.col("__start")) / F.lit(60.0), F.lit(1 / 60.0))
    return (
        sec.withColumn("__r", here).join(per, [key, "__chunk"])
        .withColumn("n_done", (F.col("__r") + F.col("__before")).cast("long"))
        .withColumn("rate", F.least(F.col("n_done") / minutes, F.lit(MAX_RATE)))
        .drop("__s", "__chunk", "__before", "__start", "__r")
    )


def ema_of(values, start: float | None, alpha: float) -> list[float]:
    """Exponential moving average seeded with its first value, or carried on from `start`."""
    out, s = [], start
    for v in values:
        s = v if s is None else alpha * v + (1 - alpha) * s
        out.append(s)
    return out


def smoothed_rates(df: DataFrame, key: str, ts: str, order: str, value: str = "rate", alpha: float = 0.2, chunk: int = 86_400) -> DataFrame:
    """`smoothed`: moving average of `value` per key in order of time.

    Two levels: a chunk maps the average before it to the one after it by
    s -> decay * s + carry, so the start of every chunk follows from one row per earlier chunk;
    then each chunk is folded by itself.
    """
    sec = df.filter(F.col(ts).isNotNull()).withColumn("__s", seconds_of(F.col(ts))).withColumn("__chunk", F.floor(F.col("__s") / chunk).cast("long"))
    cols = [c for c in df.columns]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__s", order])
        v = pdf[value].tolist()
        carry = ema_of(v, 0.0, alpha)[-1]
        seeded = ema_of(v, None, alpha)[-1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "__chunk": [pdf["__chunk"].iloc[0]], "decay": [(1 - alpha) ** len(v)], "carry": [carry], "seeded": [seeded]})

    kind = dict(df.dtypes)[key]
    keyed = sec.filter(F.col(key).isNotNull())
    parts = keyed.groupBy(key, "__chunk").applyInPandas(summary, f"`{key}` {kind}, __chunk long, decay double, carry double, seeded double")
    w = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        key, "__chunk",
        F.aggregate(
            F.collect_list(F.struct("decay", "carry", "seeded")).over(w), F.lit(None).cast("double"),
            lambda s, x: F.when(s.isNull(), x["seeded"]).otherwise(x["decay"] * s + x["carry"]),
        ).alias("__start"),
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__s", order])
        s = pdf["__start"].iloc[0]
        pdf["smoothed"] = ema_of(pdf[value].tolist(), None if pd.isna(s) else float(s), alpha)
        return pdf[[*cols, "smoothed"]]

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", smoothed double"
    return keyed.join(starts, [key, "__chunk"]).groupBy(key, "__chunk").applyInPandas(fold, schema)


def eta_minutes(total: Column, done: Column, rate: Column) -> Column:
    return F.when(total <= done, 0.0).when(rate > 0, (total - done) / rate)


def packed_by_bytes(df: DataFrame, order: str, line: str, most: int) -> DataFrame:
    """`part` so that the lines of a part stay within `most` bytes (a longer line stands alone).

    Range partitions are packed one by one in order; parts of different partitions never mix, so
    `part` is (partition, number) as text and parts in their order give the input again.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", part string"
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, number = 0, 0
        for pdf in batches:
            parts = []
            for text, p in zip(pdf[line], pdf["__p"]):
                size = len((text or "").encode()) + 1
                if used and used + size > most:
                    used, number = 0, number + 1
                used += size
                parts.append(f"{p:06d}-{number:06d}")
            yield pdf.drop(columns="__p").assign(part=parts)

    return ranged.mapInPandas(pack, schema)
