"""Reports over the contact table: each is one scan with conditional aggregates, as-of a parameter.

Groupings aggregate partially before the shuffle, so a hot country or server moves one row per
task. Top-k reports are ordered limits, which Spark runs without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.functions.common import country_code as code_of
from contactweave.functions.common import round_as_decimal, session_id
from contactweave.session import AS_OF


def as_of_column(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def within(ts: Column, interval: str, as_of: str = AS_OF) -> Column:
    """Later than `interval` before the as-of time."""
    return ts > as_of_column(as_of) - F.expr(f"INTERVAL {interval}")


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0))


def _status(name: str) -> Column:
    return _count(F.col("scrape_status") == name)


def _percent(a: Column, b: Column) -> Column:
    return round_as_decimal(a.cast("decimal(28,10)") * 100 / F.nullif(b, F.lit(0)), 1)


def totals(contacts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One row: counts by status, contacts found, coverage, activity and mean time.

    Two levels: figures per (country, server) first, then over those few rows, so that the distinct
    counts expand the groups and not the table.
    """
    parts = {
        **{f"{s}_count": _status(s) for s in ("success", "failed", "pending")},
        **{f"total_{k}": _total(f"{k}_count") for k in ("emails", "phones", "whatsapp")},
        **{f"rows_with_{k}": _count(F.col(f"has_{k}")) for k in ("email", "phone", "whatsapp")},
        **{f"rows_with_{k}": _count(F.col(f"social_{k}").isNotNull()) for k in ("facebook", "instagram")},
        "processed_24h": _count(within(F.col("updated_at"), "24 HOURS", as_of)),
        "processed_1h": _count(within(F.col("updated_at"), "1 HOUR", as_of)),
    }
    per = contacts.groupBy("country_code", "last_scrape_server").agg(
        F.count("*").alias("total_rows"), *[c.alias(n) for n, c in parts.items()],
        F.sum("scrape_time_seconds").alias("seconds"), F.count("scrape_time_seconds").alias("timed"),
    )
    added = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    return per.agg(
        added("total_rows"), *[added(n) for n in parts],
        F.countDistinct("country_code").alias("countries_count"),
        F.countDistinct("last_scrape_server").alias("active_servers"),
        round_as_decimal(F.sum("seconds") / F.nullif(F.sum("timed"), F.lit(0)), 2).alias("avg_scrape_time"),
    )


def country_stats(contacts: DataFrame) -> DataFrame:
    """Per country code and name."""
    done = _count(F.col("scrape_status").isin("success", "failed"))
    return contacts.groupBy("country_code", "country_name").agg(
        F.count("*").alias("total_rows"),
        *[_status(s).alias(f"{s}_count") for s in ("success", "failed", "pending")],
        _percent(done, F.count("*")).alias("progress_percent"),
        *[_total(f"{k}_count").alias(f"total_{k}") for k in ("emails", "phones", "whatsapp")],
        *[_count(F.col(f"has_{k}")).alias(f"rows_with_{k}") for k in ("email", "whatsapp")],
        round_as_decimal(F.avg("scrape_time_seconds"), 2).alias("avg_scrape_time"),
        F.max("updated_at").alias("last_activity"),
    ).orderBy(F.desc("total_rows"), "country_code", "country_name")


def hourly_stats(contacts: DataFrame, as_of: str = AS_OF, interval: str = "7 DAYS") -> DataFrame:
    """Per hour of the last days; per (hour, server) first, so the distinct count needs no expansion."""
    found = ("emails", "phones", "whatsapp")
    per = (
        contacts.filter(within(F.col("updated_at"), interval, as_of))
        .groupBy(F.date_trunc("hour", "updated_at").cast("timestamp_ntz").alias("hour"), "last_scrape_server")
        .agg(
            F.count("*").alias("rows_processed"), _status("success").alias("success_count"), _status("failed").alias("failed_count"),
            *[_total(f"{k}_count").alias(f"{k}_found") for k in found],
            F.sum("scrape_time_seconds").alias("seconds"), F.count("scrape_time_seconds").alias("timed"),
        )
    )
    return per.groupBy("hour").agg(
        *[F.sum(c).alias(c) for c in ("rows_processed", "success_count", "failed_count", *[f"{k}_found" for k in found])],
        round_as_decimal(F.sum("seconds") / F.nullif(F.sum("timed"), F.lit(0)), 2).alias("avg_time"),
        F.count("last_scrape_server").alias("active_servers"),
    ).orderBy(F.desc("hour"))


def hourly_rollup(contacts: DataFrame, as_of: str = AS_OF, interval: str = "7 DAYS") -> DataFrame:
    """Per hour and country with one row 'ALL' per hour, in one pass by grouping sets."""
    base = contacts.filter(within(F.col("updated_at"), interval, as_of)).select(
        F.date_trunc("hour", "updated_at").cast("timestamp_ntz").alias("stat_hour"), F.coalesce("country_code", F.lit("")).alias("country"), "scrape_status", "emails_count"
    )
    return (
        base.groupingSets([["stat_hour", "country"], ["stat_hour"]], "stat_hour", "country")
        .agg(F.grouping("country").alias("g"), F.count("*").alias("rows_processed"), _status("success").alias("success_count"), _total("emails_count").alias("emails_found"))
        .select("stat_hour", F.when(F.col("g") == 1, "ALL").otherwise(F.col("country")).alias("country_code"), "rows_processed", "success_count", "emails_found")
    )


def category_stats(contacts: DataFrame, least: int = 100, top: int = 100) -> DataFrame:
    """Categories with at least `least` rows, the `top` largest."""
    return (
        contacts.filter(F.col("business_category").isNotNull() & (F.col("business_category") != ""))
        .groupBy("business_category")
        .agg(
            F.count("*").alias("total_rows"),
            _status("success").alias("success_count"),
            _total("emails_count").alias("total_emails"),
            _total("whatsapp_count").alias("total_whatsapp"),
            _percent(_count(F.col("has_email")), F.count("*")).alias("email_rate"),
        )
        .filter(F.col("total_rows") >= least)
        .orderBy(F.desc("total_rows"), "business_category")
        .limit(top)
    )


def source_countries(results: DataFrame) -> DataFrame:
    """Source rows per country code; a missing or unparsable country is XX."""
    country = F.get_json_object("data", "$.complete_address.country")
    return results.groupBy(code_of(country).alias("country_code")).agg(F.count("*").alias("source_count"))


def country_progress(results: DataFrame, contacts: DataFrame) -> DataFrame:
    """Source against enriched rows per country: two aggregates, full outer join of their few rows."""
    enriched = contacts.groupBy("country_code").agg(
        F.count("*").alias("enriched_count"),
        _status("success").alias("success_count"),
        _status("failed").alias("failed_count"),
        *[_total(f"{k}_count").alias(f"{k}_total") for k in ("emails", "phones", "whatsapp")],
        *[_count(F.col(f"has_{k}")).alias(f"rows_with_{k}") for k in ("email", "whatsapp")],
        F.avg("scrape_time_seconds").alias("avg_time"),
        F.max("updated_at").alias("last_activity"),
    )
    joined = source_countries(results).join(enriched, "country_code", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "country_code",
        zero("source_count").alias("source_total"),
        zero("enriched_count").alias("enriched_total"),
        (zero("source_count") - zero("enriched_count")).alias("pending"),
        F.coalesce(_percent(zero("enriched_count"), zero("source_count")), F.lit(0.0)).alias("progress_percent"),
        *[zero(c).alias(c) for c in ("success_count", "failed_count", "emails_total", "phones_total", "whatsapp_total", "rows_with_email", "rows_with_whatsapp")],
        round_as_decimal(F.coalesce("avg_time", F.lit(0.0)), 2).alias("avg_scrape_time"),
        "last_activity",
    )


def overview(results: DataFrame, contacts: DataFrame, servers: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The one-row overview: three scans, each aggregated to one row, instead of one scan a figure."""
    pending = pending_links(results, contacts).agg(F.count("*").alias("pending_total"))
    return (
        totals(contacts, as_of)
        .select(
            F.col("total_rows").alias("enriched_total"), "success_count", "failed_count", "pending_count", "total_emails", "total_phones",
            "total_whatsapp", "rows_with_email", "rows_with_phone", "rows_with_whatsapp", "countries_count", "processed_24h", "processed_1h",
        )
        .join(results.agg(F.count("*").alias("source_total")))
        .join(pending)
        .join(servers.agg(F.count(F.when(F.col("status") == "online", 1)).alias("servers_online"), F.count("*").alias("servers_total")))
    )


def pending_links(results: DataFrame, contacts: DataFrame) -> DataFrame:
    """Source rows without a contact row of their link (a null link has none)."""
    source = results.select("id", F.get_json_object("data", "$.link").alias("link"))
    return source.join(contacts.select(F.col("source_link").alias("link")), "link", "left_anti")


def server_status(servers: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Health by age of the heartbeat, ordered by status and heartbeat."""
    beat = F.col("last_heartbeat")
    rank = F.when(F.col("status") == "online", 1).when(F.col("status") == "paused", 2).when(F.col("status") == "error", 3).otherwise(4)
    seconds = lambda c: F.timestamp_diff("SECOND", c, as_of_column(as_of)).cast("long")
    return servers.select(
        "server_id", "server_name", "server_region", "status", "workers_count", "current_task",
        F.when(within(beat, "2 MINUTES", as_of), "healthy").when(within(beat, "5 MINUTES", as_of), "warning").otherwise("critical").alias("health"),
        seconds(beat).alias("seconds_since_heartbeat"),
        "total_processed", "total_success", "total_failed", "success_rate", "avg_time_per_url",
        rank.cast("long").alias("status_rank"), "last_heartbeat", "last_activity", "started_at",
    ).orderBy("status_rank", F.col("last_heartbeat").desc_nulls_last(), "server_id")


def recent_activity(contacts: DataFrame, top: int = 500) -> DataFrame:
    """The latest `top` rows; ties by id."""
    return (
        contacts.select(
            "id", "country_code", "business_name", "business_category", "scrape_status", "emails_count", "phones_count", "whatsapp_count",
            F.col("social_facebook").isNotNull().alias("has_facebook"), F.col("social_instagram").isNotNull().alias("has_instagram"),
            "scrape_time_seconds", "last_scrape_server", "updated_at",
        )
        .orderBy(F.col("updated_at").desc_nulls_last(), "id")
        .limit(top)
    )


def server_totals(servers: DataFrame, contacts: DataFrame) -> DataFrame:
    """Counters after adding each server's scraped rows: additive sums, weighted mean time, guarded rate."""
    add = contacts.filter(F.col("last_scrape_server").isNotNull()).groupBy(F.col("last_scrape_server").alias("server_id")).agg(
        F.count("*").alias("n"), _status("success").alias("ok"), _status("failed").alias("bad"), _total("emails_count").alias("mails"), F.avg("scrape_time_seconds").alias("mean")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = z("total_processed") + z("n")
    return servers.join(add, "server_id", "left").select(
        "server_id",
        total.alias("total_processed"),
        (z("total_success") + z("ok")).alias("total_success"),
        (z("total_failed") + z("bad")).alias("total_failed"),
        (z("total_emails_found") + z("mails")).alias("total_emails_found"),
        round_as_decimal((F.coalesce("avg_time_per_url", F.lit(0.0)) * z("total_processed") + F.coalesce("mean", F.lit(0.0)) * z("n")) / F.nullif(total, F.lit(0)), 3).alias("avg_time_per_url"),
        round_as_decimal((z("total_success") + z("ok")).cast("double") / F.nullif(total, F.lit(0)) * 100, 2).alias("success_rate"),
    )


def job_progress(jobs: DataFrame, servers: DataFrame) -> DataFrame:
    """Jobs with their generated progress and the name of their server."""
    return jobs.join(servers.select("server_id", "server_name"), "server_id", "left").select(
        "job_id", "server_id", "server_name", "job_type", "job_status", "total_rows", "processed_rows",
        F.coalesce(_percent(F.col("processed_rows"), F.col("total_rows")), F.lit(0.0)).alias("progress_percent"),
    )


def export(
    contacts: DataFrame, columns: list[str], countries: list[str] | None = None, status: str | None = None, has_email: bool | None = None,
    categories: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int = 100_000,
) -> DataFrame:
    """Filtered columns in id order, at most 100 000 rows: the export's own bound."""
    cond = F.lit(True)
    if countries:
        cond &= F.col("country_code").isin(countries)
    if status:
        cond &= F.col("scrape_status") == status
    if has_email is not None:
        cond &= F.col("has_email") == has_email
    if categories:
        cond &= F.col("business_category").isin(categories)
    if since:
        cond &= F.col("updated_at") >= F.lit(since).cast("timestamp_ntz")
    if until:
        cond &= F.col("updated_at") < F.lit(until).cast("timestamp_ntz")
    return contacts.filter(cond).orderBy("id").limit(min(limit, 100_000)).select(*columns)


def register(servers: DataFrame, server: str, as_of: str = AS_OF) -> DataFrame:
    """The server table with `server` online in a new session whose counters start at nothing; a server it lacks is added."""
    now = F.lit(as_of).cast("timestamp_ntz")
    new = servers.sparkSession.createDataFrame([(server,)], "server_id string")
    both = servers.join(new.withColumn("__new", F.lit(True)), "server_id", "full_outer")
    hit = F.col("__new").isNotNull()
    counters = ("total_processed", "total_success", "total_failed", "total_emails_found")
    values = {c: F.when(hit, F.lit(0).cast("long")).otherwise(F.col(c)) for c in counters}
    values |= {"status": F.when(hit, "online").otherwise(F.col("status")), "session_id": F.when(hit, session_id(F.col("server_id"), now)).otherwise(F.col("session_id"))}
    values |= {c: F.when(hit, now).otherwise(F.col(c)) for c in ("started_at", "last_heartbeat")}
    return both.select(*[values[c].alias(c) if c in values else F.col(c) for c in servers.columns])


def unregister(servers: DataFrame, server: str) -> DataFrame:
    """The server table with `server` offline and without a task."""
    hit = F.col("server_id") == server
    return servers.withColumn("status", F.when(hit, "offline").otherwise(F.col("status"))).withColumn("current_task", F.when(~hit, F.col("current_task")))


def health_summary(probes: DataFrame, ok: Column, seconds: str) -> DataFrame:
    """One row: probes, good and bad ones, mean seconds of the good ones, their share in per cent."""
    good = F.coalesce(ok, F.lit(False))
    n = F.count(F.when(good, 1))
    return probes.agg(
        F.count("*").alias("probes"), n.alias("ok"), (F.count("*") - n).alias("bad"), F.round(F.coalesce(F.avg(F.when(good, F.col(seconds))), F.lit(0.0)), 3).alias("avg_seconds"),
        _percent(n, F.count("*")).alias("ok_percent"),
    )


def materialise(report: DataFrame, path: str) -> None:
    """Write a report for readers that must not wait for it; a scheduled run of this is its refresh."""
    report.coalesce(1).write.mode("overwrite").parquet(path)
