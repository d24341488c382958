"""The engine: listings and pages in, enriched contacts and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions import classify, contacts, urls, validate
from contactweave.functions.html_contacts import html_contacts
from contactweave.functions.phones import check_whatsapps, normalize_phones
from contactweave.operators import dashboard, merging, postprocess


class Engine:
    """Thin front of the operators; every method returns a DataFrame and triggers nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def enrich(self, listings: DataFrame, pages: DataFrame, fast: bool = False) -> DataFrame:
        """Listings with the contacts found on their pages, in order: header, footer, data, page.

        `listings` has a `url`, `pages` has `url`, `html` and optionally `final_url`, `fetch_error`,
        `load_seconds`, `fetched_at`, `page_id`. Pages are parsed once; several pages of one address are united in the
        order of `fetched_at` (else `page_id`). Phones are brought to E.164 where they are valid, addresses and messenger numbers
        checked. `fast` keeps four addresses, one phone, one messenger number.
        """
        has = lambda c, d: F.col(c) if c in pages.columns else F.lit(d)
        turn = next((c for c in ("fetched_at", "page_id") if c in pages.columns), None)
        found = pages.select(
            urls.clean_url(F.col("url")).alias("clean"), has("final_url", None).cast("string").alias("final_url"), has("fetch_error", None).cast("string").alias("fetch_error"),
            has("load_seconds", None).cast("double").alias("load_seconds"), (F.col(turn) if turn else F.lit(0)).alias("turn"), html_contacts("html").alias("c"),
        ).filter(F.col("clean").isNotNull())
        per = found.groupBy("clean").agg(
            F.min_by("final_url", F.when(F.col("final_url").isNotNull(), F.struct("turn", "final_url"))).alias("final_url"),
            F.min_by("fetch_error", F.when(F.col("fetch_error").isNotNull(), F.struct("turn", "fetch_error"))).alias("scraping_error"),
            F.sum("load_seconds").alias("processing_time"), F.count("*").alias("pages_scraped"),
        )
        # every distinct contact of an address with its first place: bounded by distinct values, however many pages there are
        firsts = (
            found.select("clean", "turn", F.explode("c").alias("c")).groupBy("clean", "c.field", "c.value", "c.platform").agg(F.min(F.struct("turn", "c.ord")).alias("first"))
            .groupBy("clean").agg(F.array_sort(F.collect_list(F.struct("first", "field", "value", "platform"))).alias("c"))
        )
        of = lambda field: F.array_distinct(F.transform(F.filter("c", lambda x: x["field"] == field), lambda x: x["value"]))
        mails = F.filter(
            F.transform(of("email"), contacts.normalize_email),
            lambda e: e.isNotNull() & ~contacts.is_placeholder_email(e) & contacts.is_plausible_local(F.regexp_extract(e, r"^([^@]*)@", 1)),
        )
        profile = lambda p: F.get(F.transform(F.filter("c", lambda x: x["platform"] == p), lambda x: x["value"]), F.lit(0))
        cut = (lambda a, n: F.slice(a, 1, n)) if fast else (lambda a, n: a)
        per = per.join(firsts, "clean", "left").withColumn("c", F.coalesce("c", F.array().cast(firsts.schema["c"].dataType))).select(
            "clean", "final_url", "scraping_error", "processing_time", "pages_scraped",
            cut(contacts.drop_variants(F.array_distinct(mails)), 4).alias("emails"), of("phone").alias("phones"), of("whatsapp").alias("whatsapp"),
            *[profile(p).alias(f"found_{p}") for p in ("facebook", "instagram", "tiktok", "youtube")],
        )
        base = listings.withColumn("clean", urls.clean_url(F.col("url")))
        land = F.upper(F.trim(F.col("country_code"))) if "country_code" in listings.columns else F.lit(None).cast("string")
        land = F.when(land.rlike("^[A-Z]{2}$"), land)
        out = base.join(per, "clean", "left").withColumn("phones", cut(normalize_phones("phones", land), 1)).withColumn("whatsapp", cut(normalize_phones("whatsapp", land), 1))
        mine = lambda p: F.coalesce(f"found_{p}", F.nullif(F.col(p), F.lit(""))) if p in listings.columns else F.col(f"found_{p}")
        n = lambda c: F.coalesce(F.size(c), F.lit(0))
        none = F.array().cast("array<string>")
        return out.select(
            *[c for c in listings.columns if c not in ("facebook", "instagram", "tiktok", "youtube")],
            *[mine(p).alias(p) for p in ("facebook", "instagram", "tiktok", "youtube")],
            "final_url", "emails", "phones", "whatsapp", "pages_scraped", "processing_time",
            F.coalesce("scraping_error", F.lit("")).alias("scraping_error"),
            validate.validate_batch(F.coalesce("emails", none)).alias("checked_emails"),
            check_whatsapps("whatsapp", land).alias("checked_whatsapp"),
            classify.scrape_status(F.col("url"), urls.is_social_url(F.col("clean")), F.col("scraping_error"), n("emails") + n("phones") + n("whatsapp")).alias("scraping_status"),
        )

    upsert = staticmethod(merging.upsert)
    dedupe = staticmethod(merging.keep_first)
    merge = staticmethod(merging.union_all)
    wide_form = staticmethod(postprocess.wide_form)
    report = staticmethod(postprocess.report)
    dashboard = dashboard
