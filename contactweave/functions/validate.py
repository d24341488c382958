"""Offline e-mail validation and the mapping of probe outcomes, as column ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
BIG_PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp", "icloud.com", "me.com", "aol.com",
    "protonmail.com", "mail.com",
)
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "test.com", "domain.com", "yourdomain.com", "yourcompany.com", "company.com", "email.com", "website.com",
    "site.com", "localhost", "localdomain", "127.0.0.1", "wix.com", "wixsite.com", "wordpress.com", "weebly.com", "sentry.io", "sentry.com", "github.io",
    "herokuapp.com", "dummy.com", "fake.com", "invalid.com", "placeholder.com", "xxx.com", "noreply.com", "no-reply.com",
)
PLACEHOLDER_PARTS = (
    "example", "test", "sample", "demo", "dummy", "fake", "placeholder", "domain", "website", "email", "yourname", "yourcompany", "yourdomain",
    "yoursite", "companyname", "mycompany", "myemail",
)
FALLBACK_REASONS = ("policy_denied", "blocked", "greylisted", "smtp_timeout", "connection_refused", "smtp_error", "possibly_valid")
PROVIDER_STATUS = {
    "VALID": (True, "valid"), "PROBABLY_VALID": (True, "possibly_valid"), "INVALID_FORMAT": (False, "invalid_format"),
    "INVALID_DOMAIN": (False, "domain_not_found"), "DISPOSABLE": (False, "disposable_email"),
}


def is_email_format(email: Column) -> Column:
    """One @, name of at most 64, domain of at most 255 characters with a dot, and the usual signs."""
    local = F.regexp_extract(email, r"^([^@]*)@", 1)
    domain = F.regexp_extract(email, r"^[^@]*@([^@]*)$", 1)
    return F.coalesce(
        email.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$") & (F.length(local) <= 64) & (F.length(domain) <= 255) & ~email.contains(".."),
        F.lit(False),
    )


def is_placeholder_domain(domain: Column) -> Column:
    d = F.lower(domain)
    return (
        d.isin(*PLACEHOLDER_DOMAINS) | d.rlike("|".join(PLACEHOLDER_PARTS)) | d.endswith(".local") | d.endswith(".test") | d.endswith(".invalid")
    )


def validate_email(email: Column) -> Column:
    """Struct (valid, reason, catch_all, confidence, is_big_provider) of the offline ladder.

    An address that passes the format and placeholder rules is left to a probe: reason
    `not_probed`, confidence `unknown`. Null is of invalid format.
    """
    e = F.lower(F.trim(email))
    domain = F.regexp_extract(e, r"@(.*)$", 1)
    form = is_email_format(e)
    big = form & domain.isin(*BIG_PROVIDERS)
    fake = form & is_placeholder_domain(domain)
    return F.struct(
        (form & ~fake).alias("valid"),
        F.when(~form, "invalid_format").when(fake, "placeholder_domain").otherwise("not_probed").alias("reason"),
        F.lit(False).alias("catch_all"),
        F.when(~form | fake, "high").otherwise("unknown").alias("confidence"),
        big.alias("is_big_provider"),
    )


def probe_outcome(accepted: Column, catch_all: Column, big: Column) -> Column:
    """Struct (valid, reason, confidence) of a mailbox probe; a null answer is ambiguous."""
    return F.struct(
        F.coalesce(accepted, F.lit(True)).alias("valid"),
        F.when(accepted.isNull(), "possibly_valid").when(~accepted, "smtp_invalid").when(catch_all, "catch_all").otherwise("valid").alias("reason"),
        F.when(accepted.isNull(), "medium").when(~accepted, "high").when(catch_all | big, "low").otherwise("high").alias("confidence"),
    )


def exception_reason(error: Column) -> Column:
    """Reason of a failed probe from its message."""
    e = F.lower(error)
    return (
        F.when(e.contains("timeout"), "smtp_timeout")
        .when(e.contains("connection") | e.contains("refused"), "connection_refused")
        .when(e.contains("mx") | e.contains("dns"), "mx_not_found")
        .when(e.contains("blocked") | e.contains("blacklist"), "blocked")
        .when(e.contains("greylist"), "greylisted")
        .when(e.contains("disposable"), "disposable_email")
        .otherwise("smtp_error")
    )


def error_category(error: Column) -> Column:
    """Ten-way reason of a validator's message."""
    e = F.lower(error)
    denied = e.contains("not") | e.contains("invalid")
    return (
        F.when(e.contains("mailbox") & denied, "mailbox_not_found")
        .when(e.contains("domain") & denied, "domain_not_found")
        .when(e.contains("mx"), "mx_not_found")
        .when(e.contains("timeout"), "smtp_timeout")
        .when(e.contains("connection"), "connection_refused")
        .when(e.contains("blocked") | e.contains("spam"), "blocked")
        .when(e.contains("greylist"), "greylisted")
        .when(e.contains("quota") | e.contains("full"), "mailbox_full")
        .otherwise("smtp_invalid")
    )


def needs_fallback(reason: Column) -> Column:
    return F.coalesce(reason.isin(*FALLBACK_REASONS), F.lit(False))


def provider_result(status: Column) -> Column:
    """Struct (valid, reason) of a provider's status word."""
    s = F.upper(F.coalesce(status, F.lit("")))
    valid, reason = F.lit(False), F.lit("smtp_invalid")
    for word, (v, r) in PROVIDER_STATUS.items():
        valid, reason = F.when(s == word, F.lit(v)).otherwise(valid), F.when(s == word, F.lit(r)).otherwise(reason)
    return F.struct(valid.alias("valid"), reason.alias("reason"))


def merge_results(local: Column, provider: Column) -> Column:
    """The provider's word counts when it is definite, else the local result stays."""
    definite = F.coalesce(provider["valid"], F.lit(False)) | F.coalesce(
        provider["reason"].isin("invalid_format", "domain_not_found", "disposable_email"), F.lit(False)
    )
    return F.struct(
        F.when(definite, provider["valid"]).otherwise(local["valid"]).alias("valid"),
        F.when(definite, provider["reason"]).otherwise(local["reason"]).alias("reason"),
        local["confidence"].alias("confidence"),
        local["is_big_provider"].alias("is_big_provider"),
    )


def catch_all(accepted: Column) -> Column:
    """Two or more of the random mailboxes probed at a domain were accepted."""
    return F.size(F.filter(accepted, lambda x: x)) >= 2


def validate_batch(emails: Column) -> Column:
    """map(address, result) of the distinct addresses of an array."""
    clean = F.array_distinct(F.filter(F.transform(emails, lambda e: F.lower(F.trim(e))), lambda e: e.isNotNull() & (e != "")))
    return F.map_from_entries(F.transform(clean, lambda e: F.struct(e.alias("key"), validate_email(e).alias("value"))))


def format_validated(results: Column) -> Column:
    """'address (reason:..., conf:..., big:...)' joined by '; '."""
    flag = lambda b: F.when(b, "True").otherwise("False")
    return F.array_join(
        F.transform(
            F.map_entries(results),
            lambda x: F.concat(
                x["key"], F.lit(" (reason:"), x["value"]["reason"], F.lit(", conf:"), x["value"]["confidence"], F.lit(", big:"),
                flag(x["value"]["is_big_provider"]), F.lit(")"),
            ),
        ),
        "; ",
    )
