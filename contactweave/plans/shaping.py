"""Queries of the shaping operators: wide form, deduplication, unions, splits, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.common import join_list
from contactweave.operators import merging, postprocess, rates
from contactweave.plans.registry import Registry
from contactweave.session import table

R = Registry()

_LIST = "array_to_string(coalesce({0}, []), '; ')"
_ITEMS = "list_filter(list_transform(string_split({0}, ';'), lambda x: trim(x)), lambda x: x <> '')"


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact table in the shape of the processed file."""
    z = table(spark, sf_dir, "zen_contacts")
    return z.select(
        "id", F.col("business_name").alias("name"), F.col("address").alias("street"), "country_code", F.col("business_website").alias("url"),
        F.col("scrape_status").alias("scraping_status"), F.col("scrape_error").alias("scraping_error"), F.col("scrape_time_seconds").cast("string").alias("processing_time"),
        F.col("emails_count").cast("string").alias("emails_found"), F.col("phones_count").cast("string").alias("phones_found"), F.col("whatsapp_count").cast("string").alias("whatsapp_found"),
        *[join_list(F.col(c)).alias(c) for c in ("emails", "phones", "whatsapp")], F.col("last_scrape_server").alias("sheet_name"),
    )


def _wide(c: str, p: str, n: int) -> str:
    return ", ".join(f"coalesce({_ITEMS.format(c)}[{i}], '') AS {p}_{i}" for i in range(1, n + 1))


_Z = f"(SELECT id, {_LIST.format('emails')} AS em, {_LIST.format('phones')} AS ph, {_LIST.format('whatsapp')} AS wa FROM zen_contacts)"


def _n(c: str) -> str:
    return f"len({_ITEMS.format(c)})"


@R.add(
    "wide_form",
    f"""SELECT id, {_wide('em', 'email', 3)}, {_wide('ph', 'phone', 3)}, {_wide('wa', 'whatsapp', 3)}, least({_n('em')}, 3)::INTEGER AS total_emails_extracted,
 least({_n('ph')}, 3)::INTEGER AS total_phones_extracted, least({_n('wa')}, 3)::INTEGER AS total_whatsapp_extracted, 0::INTEGER AS total_validated_emails,
 {_n('em')} > 0 OR {_n('ph')} > 0 OR {_n('wa')} > 0 AS has_contacts, false AS has_valid_emails FROM {_Z}""",
)
def wide_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.wide_form(_processed(spark, sf_dir), 3, keep=["id"])


@R.add(
    "wide_validated",
    """SELECT listing_id, e AS v_1, 'ok' AS v_1_status, '' AS v_2, '' AS v_2_status FROM (SELECT listing_id, trim(email) AS e FROM sample_input
 WHERE email IS NOT NULL AND NOT contains(email, ';') AND NOT contains(email, '(') AND trim(email) <> '')""",
)
def wide_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").filter(F.col("email").isNotNull() & ~F.col("email").contains(";") & ~F.col("email").contains("(") & (F.trim("email") != ""))
    text = F.concat(F.trim("email"), F.lit(" (reason:ok, conf:high, big:False)"))
    return s.select("listing_id", *postprocess.validated_columns(text, "v", 2))


def checked_text(validated: Column) -> Column:
    """'address (valid); address (invalid)' of the JSON object of checked addresses, in its order; null stays null."""
    items = F.map_entries(F.from_json(validated, "map<string, struct<valid: boolean, confidence: string>>"))
    status = lambda v: F.when(v["valid"], "valid").when(~v["valid"], "invalid").otherwise("unknown")
    return F.array_join(F.transform(items, lambda x: F.concat(x["key"], F.lit(" ("), status(x["value"]), F.lit(")"))), "; ")


@R.add("wide_validated_all")
def wide_validated_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts")
    return z.select("id", *postprocess.validated_columns(checked_text(F.col("emails_validated")), "v", 10))


@R.add("dedupe_first", "SELECT listing_id, name, street FROM (SELECT *, row_number() OVER (PARTITION BY name, street ORDER BY listing_id) AS k FROM sample_input) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").select("listing_id", "name", "street")
    return merging.keep_first(s, merging.dedupe_columns(s.columns), ["listing_id"])


@R.add(
    "merge_union",
    "SELECT listing_id AS id, name, url, NULL AS title FROM sample_input UNION ALL SELECT id, NULL, business_website, business_name FROM zen_contacts",
)
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "sample_input").select(F.col("listing_id").alias("id"), "name", "url")
    b = table(spark, sf_dir, "zen_contacts").select("id", F.col("business_website").alias("url"), F.col("business_name").alias("title"))
    return merging.union_all([a, b])


@R.add("merge_intersection", "SELECT listing_id AS id, url FROM sample_input UNION ALL SELECT id, business_website FROM zen_contacts")
def merge_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "sample_input").select(F.col("listing_id").alias("id"), "name", "url")
    b = table(spark, sf_dir, "zen_contacts").select("id", F.col("business_website").alias("url"), F.col("business_name").alias("title"))
    return merging.union_common([a, b])


@R.add("distinct_links", "SELECT source_link AS link FROM zen_contacts WHERE source_link IS NOT NULL UNION SELECT business_website FROM zen_contacts WHERE business_website IS NOT NULL")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts")
    one = lambda c: z.select(F.col(c).alias("link")).filter("link IS NOT NULL")
    return one("source_link").union(one("business_website")).distinct()


@R.add("top_errors", "SELECT scrape_error AS error, count(*) AS n FROM zen_contacts WHERE trim(coalesce(scrape_error, '')) <> '' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.top_errors(_processed(spark, sf_dir))


@R.add(
    "processing_report",
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE scrape_status = 'success') AS successful, count(*) FILTER (WHERE scrape_status = 'failed') AS failed,
 CAST(coalesce(sum(emails_count), 0) AS BIGINT) AS emails_found, CAST(coalesce(sum(phones_count), 0) AS BIGINT) AS phones_found, CAST(coalesce(sum(whatsapp_count), 0) AS BIGINT) AS whatsapp_found,
 count(*) FILTER (WHERE emails_count > 0) AS rows_with_emails, round(coalesce(count(*) FILTER (WHERE scrape_status = 'success') * 100.0::DOUBLE / nullif(count(*), 0), 0), 2) AS success_rate,
 round(coalesce(avg(scrape_time_seconds), 0), 3) AS avg_processing_time FROM zen_contacts""",
)
def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.report(_processed(spark, sf_dir))


_PER = """SELECT last_scrape_server AS sheet, count(*) AS n_rows, count(DISTINCT nullif(trim(country_code), '')) AS countries,
 CAST(sum(len(list_filter(coalesce(emails, []), lambda x: trim(x) <> ''))) AS BIGINT) AS emails_items, CAST(sum(len(list_filter(coalesce(phones, []), lambda x: trim(x) <> ''))) AS BIGINT) AS phones_items,
 count(*) FILTER (WHERE trim(coalesce(business_website, '')) <> '') AS with_url FROM zen_contacts GROUP BY 1"""


@R.add(
    "sheet_summary",
    f"""WITH p AS ({_PER}) SELECT * FROM p UNION ALL SELECT 'TOTAL', CAST(sum(n_rows) AS BIGINT), CAST(sum(countries) AS BIGINT), CAST(sum(emails_items) AS BIGINT),
 CAST(sum(phones_items) AS BIGINT), CAST(sum(with_url) AS BIGINT) FROM p""",
)
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.sheet_summary(_processed(spark, sf_dir))


def _sheet(c: str) -> str:
    blank = f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('nan', 'none', 'null', '-') THEN '' ELSE {c} END"
    return f"CASE WHEN regexp_matches({blank}, '^[=+\\-@]') THEN chr(39) || {blank} ELSE {blank} END"


_MAIL = f"list_filter({_ITEMS.format(_LIST.format('emails'))}, lambda x: lower(x) NOT IN ('nan', 'none', 'null', '-'))"


@R.add(
    "sheet_export",
    f"""SELECT CAST(id AS VARCHAR) AS id, {_sheet('business_name')} AS name, {_sheet('address')} AS street, {_sheet('country_code')} AS country_code, {_sheet('business_website')} AS url,
 {", ".join(f"coalesce({_MAIL}[{i}], '') AS email_{i}" for i in range(1, 5))} FROM zen_contacts""",
)
def sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.sheet_export(_processed(spark, sf_dir), ["id", "name", "street", "country_code", "url"], width=4)


@R.add(
    "file_stats",
    """SELECT batch_file AS file, count(*) AS n_rows, count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS successful,
 round(coalesce(count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') * 100.0::DOUBLE / nullif(count(*), 0), 0), 2) AS success_rate FROM sample_input GROUP BY 1""",
)
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").withColumn("scraping_status", F.when(F.coalesce(F.trim("url"), F.lit("")) != "", "success").otherwise("error"))
    return postprocess.file_stats(s)


@R.add(
    "overall_stats",
    """WITH f AS (SELECT batch_file, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS ok FROM sample_input GROUP BY 1),
 g AS (SELECT *, round(coalesce(ok * 100.0::DOUBLE / nullif(n, 0), 0), 2) AS rate FROM f)
 SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(ok) AS BIGINT) AS successful, round(avg(rate), 2) AS mean_rate,
 round(coalesce(sum(ok) * 100.0::DOUBLE / nullif(sum(n), 0), 0), 2) AS overall_rate FROM g""",
)
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.overall_stats(file_stats(spark, sf_dir))


@R.add("row_numbers", "SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS rn FROM sample_input")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.row_numbers(table(spark, sf_dir, "sample_input").select("listing_id"), ["listing_id"])


@R.add("split_even", "SELECT listing_id, ntile(7) OVER (ORDER BY listing_id) AS part FROM sample_input")
def split_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.even_split(table(spark, sf_dir, "sample_input").select("listing_id"), 7, ["listing_id"]).select("listing_id", "part")


@R.add("split_lines", "SELECT listing_id, (row_number() OVER (ORDER BY listing_id) - 1) // 250 + 1 AS part FROM sample_input")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.fixed_split(table(spark, sf_dir, "sample_input").select("listing_id"), 250, ["listing_id"]).select("listing_id", "part")


@R.add("split_bytes")
def split_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "listing_lines").select("line_id", "raw_line")
    return rates.packed_by_bytes(lines, "line_id", "raw_line", 64 * 1024).select("line_id", "part")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").filter("last_scrape_server IS NOT NULL AND updated_at IS NOT NULL")
    return z.select("id", F.col("last_scrape_server").alias("server"), F.col("updated_at").alias("ts"))


_DONE = "(SELECT id, last_scrape_server AS server, CAST(floor(epoch(updated_at)) AS BIGINT) AS s FROM zen_contacts WHERE last_scrape_server IS NOT NULL AND updated_at IS NOT NULL)"


@R.add("rolling_rate", f"SELECT id, server, count(*) OVER (PARTITION BY server ORDER BY s RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS n_recent FROM {_DONE}")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.trailing_counts(_done(spark, sf_dir), "server", "ts", 7200).select("id", "server", "n_recent")


_CUM = f"""(SELECT id, server, s, row_number() OVER w AS n, s - min(s) OVER (PARTITION BY server) AS span FROM {_DONE} WINDOW w AS (PARTITION BY server ORDER BY s, id))"""
_RATE = "least(n / greatest(span / 60.0::DOUBLE, 1 / 60.0::DOUBLE), 1000.0::DOUBLE)"


@R.add("cumulative_rate", f"SELECT id, server, n AS n_done, round({_RATE}, 6) AS rate FROM {_CUM}")
def cumulative_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.cumulative_rates(_done(spark, sf_dir), "server", "ts", "id").select("id", "server", "n_done", F.round("rate", 6).alias("rate"))


@R.add(
    "instant_rate",
    f"""WITH t AS (SELECT id, count(*) OVER w AS n, s - min(s) OVER w AS span FROM {_DONE} WINDOW w AS (PARTITION BY server ORDER BY s RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))
 SELECT id, round(CASE WHEN n >= 2 THEN least(n / greatest(span / 60.0::DOUBLE, 1 / 60.0::DOUBLE), 1000.0::DOUBLE) ELSE 0.0 END, 6) AS rate FROM t""",
)
def instant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rates.trailing_counts(_done(spark, sf_dir), "server", "ts", 7200)
    return t.select("id", F.round(rates.instant_rate(F.col("n_recent"), F.col("recent_span"), F.lit(0.0)), 6).alias("rate"))


_EMA = f"""WITH r AS (SELECT id, server, n, {_RATE} AS rate FROM {_CUM}),
 l AS (SELECT id, server, list(rate) OVER (PARTITION BY server ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rates FROM r)
 SELECT id, server, round(list_reduce(rates, lambda s, x: 0.2::DOUBLE * x + 0.8::DOUBLE * s), 6) AS smoothed FROM l"""


@R.add("ema_rate", _EMA)
def ema_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rates.cumulative_rates(_done(spark, sf_dir), "server", "ts", "id")
    return rates.smoothed_rates(r, "server", "ts", "id").select("id", "server", F.round("smoothed", 6).alias("smoothed"))
