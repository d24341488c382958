"""Queries of the reports, joins and merges over the contact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.common import partition_key, round_as_decimal
from contactweave.operators import dashboard, merging
from contactweave.plans.registry import Registry
from contactweave.session import AS_OF, table
from contactweave.sources import readers

R = Registry()
NOW = f"TIMESTAMP '{AS_OF}'"


def _pct(a: str, b: str) -> str:
    return f"CAST(round(CAST(({a}) AS DECIMAL(28,10)) * 100 / nullif({b}, 0), 1) AS DOUBLE)"


def _r(x: str, n: int) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def _sum(c: str) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS BIGINT)"


_BASE = f"""count(*) AS total_rows, count(*) FILTER (WHERE scrape_status = 'success') AS success_count,
 count(*) FILTER (WHERE scrape_status = 'failed') AS failed_count, count(*) FILTER (WHERE scrape_status = 'pending') AS pending_count"""
_FOUND = f"{_sum('emails_count')} AS total_emails, {_sum('phones_count')} AS total_phones, {_sum('whatsapp_count')} AS total_whatsapp"
_TOTALS = f"""SELECT {_BASE}, {_FOUND}, count(*) FILTER (WHERE has_email) AS rows_with_email, count(*) FILTER (WHERE has_phone) AS rows_with_phone,
 count(*) FILTER (WHERE has_whatsapp) AS rows_with_whatsapp, count(social_facebook) AS rows_with_facebook, count(social_instagram) AS rows_with_instagram,
 count(DISTINCT country_code) AS countries_count, count(DISTINCT last_scrape_server) AS active_servers,
 count(*) FILTER (WHERE updated_at > {NOW} - INTERVAL 24 HOUR) AS processed_24h, count(*) FILTER (WHERE updated_at > {NOW} - INTERVAL 1 HOUR) AS processed_1h,
 {_r('avg(scrape_time_seconds)', 2)} AS avg_scrape_time FROM zen_contacts"""


@R.add("dashboard_totals", _TOTALS)
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.totals(table(spark, sf_dir, "zen_contacts"))


_LINK = "json_extract_string(TRY_CAST(data AS JSON), '$.link')"
_PENDING = f"SELECT id, {_LINK} AS link FROM results r WHERE NOT EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK})"


def _valid(df: DataFrame) -> DataFrame:
    """Rows of the JSON source whose document parses as a whole."""
    return readers.parsable(df)


@R.add(
    "dashboard_overview",
    f"""WITH t AS ({_TOTALS}) SELECT total_rows AS enriched_total, success_count, failed_count, pending_count, total_emails, total_phones, total_whatsapp,
 rows_with_email, rows_with_phone, rows_with_whatsapp, countries_count, processed_24h, processed_1h,
 (SELECT count(*) FROM results WHERE TRY_CAST(data AS JSON) IS NOT NULL) AS source_total,
 (SELECT count(*) FROM ({_PENDING} AND TRY_CAST(data AS JSON) IS NOT NULL)) AS pending_total,
 (SELECT count(*) FROM zen_servers WHERE status = 'online') AS servers_online, (SELECT count(*) FROM zen_servers) AS servers_total FROM t""",
)
def dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.overview(
        _valid(table(spark, sf_dir, "results")), table(spark, sf_dir, "zen_contacts"), table(spark, sf_dir, "zen_servers")
    )


@R.add(
    "country_stats",
    f"""SELECT country_code, country_name, {_BASE},
 {_pct("count(*) FILTER (WHERE scrape_status IN ('success','failed'))", 'count(*)')} AS progress_percent, {_FOUND},
 count(*) FILTER (WHERE has_email) AS rows_with_email, count(*) FILTER (WHERE has_whatsapp) AS rows_with_whatsapp,
 {_r('avg(scrape_time_seconds)', 2)} AS avg_scrape_time, max(updated_at) AS last_activity FROM zen_contacts GROUP BY country_code, country_name""",
)
def country_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.country_stats(table(spark, sf_dir, "zen_contacts"))


_HOURLY = f"""count(*) AS rows_processed, count(*) FILTER (WHERE scrape_status = 'success') AS success_count,
 count(*) FILTER (WHERE scrape_status = 'failed') AS failed_count, {_sum('emails_count')} AS emails_found, {_sum('phones_count')} AS phones_found,
 {_sum('whatsapp_count')} AS whatsapp_found, {_r('avg(scrape_time_seconds)', 2)} AS avg_time, count(DISTINCT last_scrape_server) AS active_servers"""


@R.add(
    "hourly_stats",
    f"SELECT date_trunc('hour', updated_at) AS hour, {_HOURLY} FROM zen_contacts WHERE updated_at > {NOW} - INTERVAL 7 DAY GROUP BY 1",
)
def hourly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hourly_stats(table(spark, sf_dir, "zen_contacts"))


@R.add(
    "hourly_rollup",
    f"""WITH b AS (SELECT date_trunc('hour', updated_at) AS stat_hour, coalesce(country_code, '') AS c, scrape_status, emails_count FROM zen_contacts
 WHERE updated_at > {NOW} - INTERVAL 7 DAY)
 SELECT stat_hour, c AS country_code, count(*) AS rows_processed, count(*) FILTER (WHERE scrape_status = 'success') AS success_count, {_sum('emails_count')} AS emails_found FROM b GROUP BY 1, 2
 UNION ALL SELECT stat_hour, 'ALL', count(*), count(*) FILTER (WHERE scrape_status = 'success'), {_sum('emails_count')} FROM b GROUP BY 1""",
)
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hourly_rollup(table(spark, sf_dir, "zen_contacts"))


@R.add(
    "category_stats",
    f"""SELECT business_category, count(*) AS total_rows, count(*) FILTER (WHERE scrape_status = 'success') AS success_count,
 {_sum('emails_count')} AS total_emails, {_sum('whatsapp_count')} AS total_whatsapp, {_pct('count(*) FILTER (WHERE has_email)', 'count(*)')} AS email_rate
 FROM zen_contacts WHERE business_category IS NOT NULL AND business_category <> '' GROUP BY 1 HAVING count(*) >= 20
 ORDER BY total_rows DESC, business_category LIMIT 100""",
)
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.category_stats(table(spark, sf_dir, "zen_contacts"), least=20)


_COUNTRY = "upper(substr(coalesce(json_extract_string(TRY_CAST(data AS JSON), '$.complete_address.country'), 'XX'), 1, 2))"


@R.add("source_countries", f"SELECT {_COUNTRY} AS country_code, count(*) AS source_count FROM results WHERE TRY_CAST(data AS JSON) IS NOT NULL GROUP BY 1")
def source_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.source_countries(_valid(table(spark, sf_dir, "results")))


@R.add(
    "country_progress",
    f"""WITH s AS (SELECT {_COUNTRY} AS country_code, count(*) AS n FROM results WHERE TRY_CAST(data AS JSON) IS NOT NULL GROUP BY 1),
 e AS (SELECT country_code, count(*) AS n, count(*) FILTER (WHERE scrape_status = 'success') AS ok, count(*) FILTER (WHERE scrape_status = 'failed') AS bad,
 {_sum('emails_count')} AS m, {_sum('phones_count')} AS p, {_sum('whatsapp_count')} AS w, count(*) FILTER (WHERE has_email) AS he,
 count(*) FILTER (WHERE has_whatsapp) AS hw, avg(scrape_time_seconds) AS t, max(updated_at) AS last FROM zen_contacts GROUP BY 1)
 SELECT coalesce(s.country_code, e.country_code) AS country_code, coalesce(s.n, 0) AS source_total, coalesce(e.n, 0) AS enriched_total,
 coalesce(s.n, 0) - coalesce(e.n, 0) AS pending, coalesce({_pct('coalesce(e.n, 0)', 'coalesce(s.n, 0)')}, 0.0) AS progress_percent,
 coalesce(ok, 0) AS success_count, coalesce(bad, 0) AS failed_count, coalesce(m, 0) AS emails_total, coalesce(p, 0) AS phones_total,
 coalesce(w, 0) AS whatsapp_total, coalesce(he, 0) AS rows_with_email, coalesce(hw, 0) AS rows_with_whatsapp,
 {_r('coalesce(t, 0.0)', 2)} AS avg_scrape_time, last AS last_activity FROM s FULL OUTER JOIN e ON s.country_code = e.country_code""",
)
def country_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.country_progress(_valid(table(spark, sf_dir, "results")), table(spark, sf_dir, "zen_contacts"))


@R.add(
    "server_status",
    f"""SELECT server_id, server_name, server_region, status, workers_count, current_task,
 CASE WHEN last_heartbeat > {NOW} - INTERVAL 2 MINUTE THEN 'healthy' WHEN last_heartbeat > {NOW} - INTERVAL 5 MINUTE THEN 'warning' ELSE 'critical' END AS health,
 CAST(floor(epoch({NOW}) - epoch(last_heartbeat)) AS BIGINT) AS seconds_since_heartbeat, total_processed, total_success, total_failed, success_rate, avg_time_per_url,
 CAST(CASE status WHEN 'online' THEN 1 WHEN 'paused' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS BIGINT) AS status_rank, last_heartbeat, last_activity, started_at FROM zen_servers""",
)
def server_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.server_status(table(spark, sf_dir, "zen_servers"))


_RECENT = """SELECT id, country_code, business_name, business_category, scrape_status, emails_count, phones_count, whatsapp_count,
 social_facebook IS NOT NULL AS has_facebook, social_instagram IS NOT NULL AS has_instagram, scrape_time_seconds, last_scrape_server, updated_at
 FROM zen_contacts ORDER BY updated_at DESC NULLS LAST, id LIMIT {}"""


@R.add("recent_activity", _RECENT.format(500))
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.recent_activity(table(spark, sf_dir, "zen_contacts"))


@R.add("recent_scrapes", _RECENT.format(1000))
def recent_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.recent_activity(table(spark, sf_dir, "zen_contacts"), top=1000)


@R.add(
    "server_totals",
    f"""WITH a AS (SELECT last_scrape_server AS server_id, count(*) AS n, count(*) FILTER (WHERE scrape_status = 'success') AS ok,
 count(*) FILTER (WHERE scrape_status = 'failed') AS bad, {_sum('emails_count')} AS mails, avg(scrape_time_seconds) AS mean FROM zen_contacts
 WHERE last_scrape_server IS NOT NULL GROUP BY 1),
 j AS (SELECT s.server_id, coalesce(total_processed, 0) AS p, coalesce(n, 0) AS n, coalesce(total_success, 0) + coalesce(ok, 0) AS ok,
 coalesce(total_failed, 0) + coalesce(bad, 0) AS bad, coalesce(total_emails_found, 0) + coalesce(mails, 0) AS mails, coalesce(avg_time_per_url, 0.0) AS old, coalesce(mean, 0.0) AS mean
 FROM zen_servers s LEFT JOIN a USING (server_id))
 SELECT server_id, p + n AS total_processed, ok AS total_success, bad AS total_failed, mails AS total_emails_found,
 {_r('(old * p + mean * n) / nullif(p + n, 0)', 3)} AS avg_time_per_url, {_r('CAST(ok AS DOUBLE) / nullif(p + n, 0) * 100', 2)} AS success_rate FROM j""",
)
def server_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.server_totals(table(spark, sf_dir, "zen_servers"), table(spark, sf_dir, "zen_contacts"))


@R.add(
    "job_progress",
    f"""SELECT job_id, j.server_id, server_name, job_type, job_status, total_rows, processed_rows,
 coalesce({_pct('processed_rows', 'total_rows')}, 0.0) AS progress_percent FROM zen_jobs j LEFT JOIN zen_servers s ON j.server_id = s.server_id""",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.job_progress(table(spark, sf_dir, "zen_jobs"), table(spark, sf_dir, "zen_servers"))


@R.add("pending_anti", f"{_PENDING} AND TRY_CAST(data AS JSON) IS NOT NULL")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.pending_links(_valid(table(spark, sf_dir, "results")), table(spark, sf_dir, "zen_contacts")).select("id", "link")


@R.add(
    "completed_semi",
    f"SELECT id, {_LINK} AS link FROM results r WHERE TRY_CAST(data AS JSON) IS NOT NULL AND EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK})",
)
def completed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _valid(table(spark, sf_dir, "results")).select("id", F.get_json_object("data", "$.link").alias("link"))
    return source.join(table(spark, sf_dir, "zen_contacts").select(F.col("source_link").alias("link")), "link", "left_semi").select("id", "link")


@R.add(
    "pending_by_country",
    f"""SELECT {_COUNTRY} AS country_code, count(*) AS pending FROM results r WHERE TRY_CAST(data AS JSON) IS NOT NULL
 AND trim(coalesce(json_extract_string(TRY_CAST(data AS JSON), '$.web_site'), '')) <> ''
 AND NOT EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK}) GROUP BY 1""",
)
def pending_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _valid(table(spark, sf_dir, "results")).filter(F.trim(F.coalesce(F.get_json_object("data", "$.web_site"), F.lit(""))) != "")
    pending = dashboard.pending_links(results, table(spark, sf_dir, "zen_contacts"))
    return dashboard.source_countries(results.join(pending.select("id"), "id", "left_semi")).withColumnRenamed("source_count", "pending")


@R.add(
    "claim_batch",
    f"""SELECT id, {_LINK} AS link FROM results r WHERE TRY_CAST(data AS JSON) IS NOT NULL
 AND upper(substr(json_extract_string(TRY_CAST(data AS JSON), '$.complete_address.country'), 1, 2)) = 'MT'
 AND NOT EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK}) ORDER BY id LIMIT 100""",
)
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.upper(F.substring(F.get_json_object("data", "$.complete_address.country"), 1, 2))
    results = _valid(table(spark, sf_dir, "results")).filter(country == "MT")
    return dashboard.pending_links(results, table(spark, sf_dir, "zen_contacts")).select("id", "link").orderBy("id").limit(100)


@R.add(
    "completion_counts",
    f"""WITH d AS (SELECT {_LINK} AS link, EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK}) AS there FROM results WHERE TRY_CAST(data AS JSON) IS NOT NULL)
 SELECT count(*) AS total, count(*) FILTER (WHERE there) AS completed, count(*) FILTER (WHERE NOT there) AS pending FROM d""",
)
def completion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "zen_contacts").select(F.col("source_link").alias("link")).distinct().withColumn("there", F.lit(True))
    source = _valid(table(spark, sf_dir, "results")).select(F.get_json_object("data", "$.link").alias("link"))
    there = F.col("there").isNotNull()
    return source.join(done, "link", "left").agg(
        F.count("*").alias("total"), F.count(F.when(there, 1)).alias("completed"), F.count(F.when(~there, 1)).alias("pending")
    )


@R.add("contacts_with_emails", "SELECT id, source_link, emails_count FROM zen_contacts WHERE emails_count > 0")
def contacts_with_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_contacts").filter("emails_count > 0").select("id", "source_link", "emails_count")


@R.add(
    "export_filter",
    f"""SELECT id, business_name, country_code, emails_count, updated_at FROM zen_contacts WHERE country_code IN ('MT', 'DE', 'FR') AND scrape_status = 'success'
 AND has_email AND updated_at >= TIMESTAMP '2025-06-01 00:00:00' AND updated_at < {NOW} ORDER BY id LIMIT 100000""",
)
def export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.export(
        table(spark, sf_dir, "zen_contacts"), ["id", "business_name", "country_code", "emails_count", "updated_at"], countries=["MT", "DE", "FR"],
        status="success", has_email=True, since="2025-06-01 00:00:00", until=AS_OF,
    )


@R.add("partition_key", "SELECT id, CAST(CAST('0x' || substr(md5(source_link), 1, 8) AS BIGINT) % 32 AS INTEGER) AS pkey FROM zen_contacts")
def partition_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_contacts").select("id", partition_key(F.col("source_link")).alias("pkey"))


_OTHERS = (
    "source_id business_name business_category business_website country_code country_name city state address postal_code latitude longitude timezone gmaps_phone gmaps_rating "
    "gmaps_review_count gmaps_price_range gmaps_cid gmaps_status emails_validated whatsapp_validated social_linkedin social_twitter social_count created_at"
).split()
_FIRST_BY, _LAST_BY = "ORDER BY updated_at NULLS FIRST, id", "ORDER BY updated_at DESC NULLS LAST, id DESC"


def _uni(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(flatten(list(coalesce({c}, []))), lambda x: x IS NOT NULL AND x <> '')))"


@R.add(
    "upsert_contacts",
    f"""SELECT source_link, {", ".join(f"array_to_string({_uni(c)}, ',') AS {c}, len({_uni(c)})::INTEGER AS {c}_count" for c in merging.ARRAYS)},
 len({_uni('emails')}) > 0 AS has_email, len({_uni('phones')}) > 0 AS has_phone, len({_uni('whatsapp')}) > 0 AS has_whatsapp,
 {", ".join(f"first({c} {_LAST_BY}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in merging.SOCIALS)}, {", ".join(f"first({c} {_LAST_BY}) AS {c}" for c in merging.OVERWRITTEN)},
 {", ".join(f"first({c} {_FIRST_BY}) AS {c}" for c in _OTHERS)},
 (CASE WHEN count(*) = 1 THEN 1 ELSE coalesce(first(scrape_count {_FIRST_BY}), 0) + count(*) - 1 END)::INTEGER AS scrape_count, {NOW} AS updated_at, {NOW} AS last_scrape_at,
 CAST(CAST('0x' || substr(md5(source_link), 1, 8) AS BIGINT) % 32 AS INTEGER) AS partition_key FROM zen_contacts WHERE source_link IS NOT NULL GROUP BY source_link""",
)
def upsert_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every link merged into the table of all earlier ones."""
    c = table(spark, sf_dir, "zen_contacts").filter(F.col("source_link").isNotNull())
    new = merging.latest_per_key(c, "source_link", ["updated_at", "id"])
    old = merging.fold_generations(c.join(new.select("id"), "id", "left_anti"), ["updated_at", "id"])
    m = merging.upsert(old, new)
    return m.drop("id").withColumns({a: F.array_join(F.array_sort(a), ",") for a in merging.ARRAYS})


@R.add("latest_per_link", "SELECT source_link, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY source_link ORDER BY updated_at DESC, id DESC) AS k FROM zen_contacts WHERE source_link IS NOT NULL) WHERE k = 1")
def latest_per_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "zen_contacts").filter(F.col("source_link").isNotNull()).select("source_link", "id", "updated_at")
    return merging.latest_per_key(c, "source_link", ["updated_at", "id"])


@R.add(
    "insert_missing",
    f"""SELECT source_link AS link, 'contacts' AS origin FROM zen_contacts WHERE source_link IS NOT NULL
 UNION ALL SELECT {_LINK}, 'results' FROM results r WHERE TRY_CAST(data AS JSON) IS NOT NULL AND {_LINK} IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM zen_contacts c WHERE c.source_link = {_LINK})""",
)
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "zen_contacts").filter(F.col("source_link").isNotNull()).select(F.col("source_link").alias("link"), F.lit("contacts").alias("origin"))
    new = _valid(table(spark, sf_dir, "results")).select(F.get_json_object("data", "$.link").alias("link"), F.lit("results").alias("origin")).filter(F.col("link").isNotNull())
    return merging.insert_missing(old, new, ["link"])


@R.add(
    "migration_counts",
    "SELECT 'results' AS name, count(*) AS n FROM results UNION ALL SELECT 'zen_contacts', count(*) FROM zen_contacts",
)
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t: table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n")
    return count("results").unionByName(count("zen_contacts"))


@R.add("country_top20", "SELECT country_code, count(*) AS n FROM zen_contacts GROUP BY 1 ORDER BY n DESC, country_code NULLS FIRST LIMIT 20")
def country_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_contacts").groupBy("country_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("country_code").asc_nulls_first()).limit(20)


@R.add(
    "country_lookup",
    """SELECT z.id, coalesce(c.country_code, 'XX') AS country, coalesce(c.country_name, '') AS country_name_ref FROM zen_contacts z
 LEFT JOIN country_ref c ON upper(trim(z.country_code)) = c.country_code""",
)
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = table(spark, sf_dir, "country_ref").select(F.col("country_code").alias("code"), F.col("country_name").alias("ref_name"))
    z = table(spark, sf_dir, "zen_contacts")
    return z.join(ref, F.upper(F.trim("country_code")) == F.col("code"), "left").select(
        "id", F.coalesce("code", F.lit("XX")).alias("country"), F.coalesce("ref_name", F.lit("")).alias("country_name_ref")
    )


@R.add(
    "fetch_efficiency",
    f"""SELECT status_code, count(*) AS n, count(*) FILTER (WHERE html IS NOT NULL AND html <> '') AS with_html,
 {_r('avg(load_seconds)', 3)} AS avg_seconds, count(fetch_error) AS errors FROM pages GROUP BY 1""",
)
def fetch_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("status_code").agg(
        F.count("*").alias("n"), F.count(F.when(F.length("html") > 0, 1)).alias("with_html"), round_as_decimal(F.avg("load_seconds"), 3).alias("avg_seconds"),
        F.count("fetch_error").alias("errors"),
    )
