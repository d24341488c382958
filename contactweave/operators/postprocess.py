"""Shaping of processed listings: wide form, summary, reports, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.functions.common import first_filled, formula_guard, join_list, safe_div, sheet_value, split_list
from contactweave.functions.urls import was_redirected
from contactweave.functions.validate import format_validated

#: Columns of the processed listing file, in order (fixed values).
OUTPUT_COLUMNS = (
    "No", "name", "street", "city", "country_code", "url", "phone_number", "google_business_categories", "facebook", "instagram", "tiktok", "youtube",
    "final_url", "was_redirected", "emails", "phones", "whatsapp", "email", "validated_emails", "validated_whatsapp", "scraping_status", "scraping_error",
    "processing_time", "pages_scraped", "emails_found", "phones_found", "whatsapp_found", "validated_emails_count", "validated_whatsapp_count",
)
#: Other names a listing column goes by (fixed values).
ALIASES = {
    "name": ("name", "title", "business_name", "company_name"),
    "phone_number": ("phone_number", "phone", "phone_mobile"),
    "google_business_categories": ("google_business_categories", "category", "categories", "type"),
    "email": ("email", "emails", "email_address"),
    "url": ("url", "website", "link", "site", "domain"),
}
#: Columns read by their exact name, and words that make any other column worth reading (fixed values).
_EXACT = (
    "name", "street", "city", "country_code", "url", "phone_number", "google_business_categories", "facebook", "instagram", "email",
    "title", "website", "phone", "category", "complete_address", "emails",
)
_USEFUL = ("title", "name", "category", "address", "phone", "emails", "email", "facebook", "instagram", "linkedin", "twitter", "whatsapp", "website", "complete_address")
_ADDRESS = "street string, city string, state string, country string, postal_code string"


def url_column(columns: Sequence[str]) -> str | None:
    """First column that holds the web address."""
    return next((c for c in ALIASES["url"] if c in columns), None)


def useful_columns(columns: Sequence[str]) -> list[str]:
    """Columns worth reading, without unnamed ones: the address, the exact names, and what holds a useful word."""
    url = url_column(columns)
    return [c for c in columns if not c.startswith("Unnamed:") and (c == url or c in _EXACT or any(u in c.lower() for u in _USEFUL))]


def aliased(df: DataFrame, name: str) -> Column:
    """First filled column among the aliases of `name`, trimmed, '' without one."""
    there = [F.col(f"`{c}`") for c in ALIASES.get(name, (name,)) if c in df.columns]
    return first_filled(*there) if there else F.lit("")


def standard_listing(df: DataFrame) -> DataFrame:
    """Either model of the listing file as the standard columns; address JSON fills what is empty."""
    if "complete_address" in df.columns:
        a = F.from_json("complete_address", _ADDRESS)
        filled = {"street": a["street"], "city": F.coalesce(F.nullif(a["city"], F.lit("")), a["state"]), "country_code": a["country"]}
    else:
        filled = {}
    names = ("name", "street", "city", "country_code", "url", "phone_number", "google_business_categories", "email", "facebook", "instagram")
    return df.select(
        *[F.coalesce(F.nullif(aliased(df, n), F.lit("")), F.coalesce(filled.get(n, F.lit("")), F.lit(""))).alias(n) for n in names]
    )


def wide_columns(items: Column, prefix: str, n: int) -> list[Column]:
    """prefix_1..n of an array, '' where it is shorter."""
    return [F.coalesce(F.get(items, F.lit(i)), F.lit("")).alias(f"{prefix}_{i + 1}") for i in range(n)]


def format_whatsapp(results: Column) -> Column:
    """'number (valid:..., type:..., country:..., reason:...)' joined by '; '."""
    one = lambda x: F.concat(
        x["number"], F.lit(" (valid:"), F.when(x["valid"], "True").otherwise("False"), F.lit(", type:"), x["type"], F.lit(", country:"), x["country"], F.lit(", reason:"), x["reason"], F.lit(")")
    )
    return F.array_join(F.transform(F.coalesce(results, F.array().cast("array<struct<number:string,valid:boolean,type:string,country:string,reason:string>>")), one), "; ")


def validated_columns(text: Column, prefix: str, n: int) -> list[Column]:
    """Address and status of 'address (status)' or 'address (reason:..., ...)' items; no brackets: unknown."""
    items = F.filter(F.transform(F.split(text, r";"), lambda x: F.trim(x)), lambda x: x != "")
    out = []
    for i in range(n):
        x = F.get(items, F.lit(i))
        inner = F.regexp_extract(x, r"\(([^)]*)\)", 1)
        reason = F.regexp_extract(inner, r"reason:([^,]*)", 1)
        status = F.when(~x.contains("("), "unknown").when(reason != "", F.trim(reason)).otherwise(F.trim(inner))
        out += [
            F.coalesce(F.trim(F.regexp_extract(x, r"^([^(]*)", 1)), F.lit("")).alias(f"{prefix}_{i + 1}"),
            F.coalesce(status, F.lit("")).alias(f"{prefix}_{i + 1}_status"),
        ]
    return out


def wide_form(df: DataFrame, n: int = 10, keep: Sequence[str] | None = None) -> DataFrame:
    """Separate columns per contact and summary columns over the generated ones only."""
    mails, phones, wa = (split_list(F.col(c)) for c in ("emails", "phones", "whatsapp"))
    checked = split_list(F.col("validated_emails")) if "validated_emails" in df.columns else F.array().cast("array<string>")
    count = lambda a: F.least(F.size(a), F.lit(n)).cast("int")
    validated = validated_columns(F.col("validated_emails"), "validated_email", n) if "validated_emails" in df.columns else []
    return df.select(
        *(keep if keep is not None else df.columns),
        *wide_columns(mails, "email", n), *validated, *wide_columns(phones, "phone", n), *wide_columns(wa, "whatsapp", n),
        count(mails).alias("total_emails_extracted"), count(phones).alias("total_phones_extracted"), count(wa).alias("total_whatsapp_extracted"),
        count(checked).alias("total_validated_emails"),
        ((F.size(mails) > 0) | (F.size(phones) > 0) | (F.size(wa) > 0)).alias("has_contacts"),
        (F.size(checked) > 0).alias("has_valid_emails"),
    )


def output_rows(df: DataFrame, row_number: Column) -> DataFrame:
    """The 29 columns of the processed file from listing columns and the enriched arrays."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    values = {c: blank(c) for c in OUTPUT_COLUMNS}
    counted = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) if c in df.columns else F.lit(0)
    values |= {
        "validated_emails": format_validated(F.col("checked_emails")) if "checked_emails" in df.columns else blank("validated_emails"),
        "validated_whatsapp": format_whatsapp(F.col("checked_whatsapp")) if "checked_whatsapp" in df.columns else F.lit(""),
        "validated_emails_count": counted("checked_emails"),
        "validated_whatsapp_count": counted("checked_whatsapp"),
        "No": row_number.cast("string"),
        "was_redirected": was_redirected(blank("url"), blank("final_url")),
        **{c: join_list(F.col(c)) for c in ("emails", "phones", "whatsapp")},
        **{f"{c}_found": n(c) for c in ("emails", "phones", "whatsapp")},
    }
    return df.select(*[values[c].alias(c) for c in OUTPUT_COLUMNS])


def report(df: DataFrame) -> DataFrame:
    """One row of figures over processed rows; numbers are cast, ratios guarded."""
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    ok = F.count(F.when(F.col("scraping_status") == "success", 1))
    return df.agg(
        F.count("*").alias("total_rows"),
        ok.alias("successful"),
        F.count(F.when(F.col("scraping_status") == "failed", 1)).alias("failed"),
        number("emails_found").alias("emails_found"), number("phones_found").alias("phones_found"), number("whatsapp_found").alias("whatsapp_found"),
        F.count(F.when(F.col("emails_found").cast("long") > 0, 1)).alias("rows_with_emails"),
        F.round(safe_div(ok * F.lit(100.0), F.count("*")), 2).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.col("processing_time").cast("double")), F.lit(0.0)), 3).alias("avg_processing_time"),
    )


def wide_report(df: DataFrame, n: int = 10) -> DataFrame:
    """One row of figures over the wide form: rows, rows with contacts and valid e-mails, contacts of each kind."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    w = wide_form(df, n, keep=[])
    return w.agg(
        F.count("*").alias("total_rows"), F.count(F.when(F.col("has_contacts"), 1)).alias("rows_with_contacts"), F.count(F.when(F.col("has_valid_emails"), 1)).alias("rows_with_valid_emails"),
        total("total_emails_extracted").alias("total_emails"), total("total_phones_extracted").alias("total_phones"), total("total_whatsapp_extracted").alias("total_whatsapp"),
        total("total_validated_emails").alias("total_validated_emails"), F.round(safe_div(F.count(F.when(F.col("has_contacts"), 1)) * F.lit(100.0), F.count("*")), 2).alias("contact_rate"),
    )


#: Columns of the result for a single address (fixed values).
SINGLE_COLUMNS = ("url", "final_url", "was_redirected", "emails", "phones", "whatsapp", "facebook", "instagram", "tiktok", "youtube", "scraping_status", "processing_time", "pages_scraped")


def top_errors(df: DataFrame, col: str = "scraping_error", top: int = 5) -> DataFrame:
    """Most frequent errors, ties by text."""
    return (
        df.filter(F.coalesce(F.trim(col), F.lit("")) != "").groupBy(F.col(col).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(top)
    )


def sheet_summary(df: DataFrame, sheet: str = "sheet_name") -> DataFrame:
    """Figures per sheet and a TOTAL row that adds them up (distincts are summed, not counted anew)."""
    items = lambda c: F.sum(F.size(split_list(F.col(c)))).alias(f"{c}_items")
    per = df.groupBy(F.col(sheet).alias("sheet")).agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.nullif(F.trim("country_code"), F.lit(""))).alias("countries"), items("emails"), items("phones"),
        F.count(F.when(F.coalesce(F.trim("url"), F.lit("")) != "", 1)).alias("with_url"),
    )
    total = per.agg(F.lit("TOTAL").alias("sheet"), *[F.sum(c).alias(c) for c in per.columns[1:]])
    return per.unionByName(total)


def sheet_export(df: DataFrame, columns: Sequence[str], most: int = 4, width: int | None = None) -> DataFrame:
    """Sheet-shaped rows: placeholders blanked, formulas guarded, at most `most` e-mail columns.

    E-mail columns exist only as far as any row needs them; that width is one aggregate, unless it is given.
    """
    mails = F.slice(F.filter(split_list(F.col("emails")), lambda e: ~F.lower(e).isin("nan", "none", "null", "-")), 1, most)
    width = df.agg(F.coalesce(F.max(F.size(mails)), F.lit(0))).first()[0] if width is None else width
    return df.select(
        *[formula_guard(sheet_value(F.col(c).cast("string"))).alias(c) for c in columns],
        *wide_columns(mails, "email", max(1, min(most, width))),
    )


def file_stats(df: DataFrame, file_col: str = "batch_file") -> DataFrame:
    """Rows, successes and guarded rate per file."""
    ok = F.count(F.when(F.col("scraping_status") == "success", 1))
    return df.groupBy(F.col(file_col).alias("file")).agg(F.count("*").alias("n_rows"), ok.alias("successful"), F.round(safe_div(ok * F.lit(100.0), F.count("*")), 2).alias("success_rate"))


def overall_stats(per_file: DataFrame) -> DataFrame:
    """Sum and mean over files."""
    return per_file.agg(
        F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("successful").alias("successful"), F.round(F.avg("success_rate"), 2).alias("mean_rate"),
        F.round(safe_div(F.sum("successful") * F.lit(100.0), F.sum("n_rows")), 2).alias("overall_rate"),
    )
