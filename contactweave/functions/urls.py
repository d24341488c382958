"""URL cleaning as pure column expressions: no Python worker, one fused projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that carry tracking, compared in lower case (fixed values).
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id", "utm_source_platform", "utm_creative_format",
    "opi", "sa", "ved", "usg", "ei", "hl", "fbclid", "efg", "gclid", "msclkid", "kwid", "_ga", "mc_cid", "mc_eid",
    "ref", "referrer", "source", "campaign", "sid", "sessionid", "phpsessid", "nocache", "cache", "_cachebust",
    "an", "aid", "an_id", "adid", "adset_id", "campaign_id", "piwik_id", "pk_campaign", "pk_kwd",
)
#: Hosts whose pages are profiles, not websites of their own (fixed values).
SOCIAL_DOMAINS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "tiktok.com",
    "pinterest.com", "vk.com", "snapchat.com", "wa.me", "web.whatsapp.com", "discord.com",
)


def staged(c: Column, *steps) -> Column:
    """Each step over the result of the one before, evaluated once: nesting the expressions of a
    pipeline would repeat every earlier step as often as a later one reads it."""
    def bind(value: Column, step) -> Column:
        return F.get(F.transform(F.array(value), lambda x: step(x)), F.lit(0))

    return reduce(bind, steps, c)


def decode(c: Column) -> Column:
    """Percent-decoding that keeps `+`; a value with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def query_of(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(u, r"#.*$", ""), r"\?(.*)$", 1)


def path_of(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def scheme_of(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc_of(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host_of(u: Column) -> Column:
    """Lower-case host without port and credentials."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc_of(u), r"^.*@", ""), r":\d*$", ""))


def base_url(u: Column) -> Column:
    """scheme://netloc."""
    return F.concat(scheme_of(u), F.lit("://"), netloc_of(u))


def is_google_redirect(u: Column) -> Column:
    return F.coalesce(path_of(u).contains("/url") & query_of(u).contains("q="), F.lit(False))


def _params(u: Column) -> Column:
    """Non-empty parameters as (k, v), decoded, in order."""
    return F.transform(
        F.filter(F.split(query_of(u), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _form_decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _form_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def redirect_target(u: Column) -> Column:
    """First non-blank `q`, decoded twice; null when there is none."""
    q = F.get(F.filter(_params(u), lambda p: (p["k"] == "q") & (p["v"] != "")), F.lit(0))["v"]
    return decode(q)


def remove_tracking(u: Column, params: Sequence[str] = TRACKING_PARAMS) -> Column:
    """Without tracking parameters and fragment; of a repeated key the first value stays, decoded."""
    kept = F.filter(_params(u), lambda p: ~F.lower(p["k"]).isin(list(params)))
    keys = F.transform(kept, lambda p: p["k"])
    first = F.filter(kept, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    q = F.array_join(F.transform(first, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    scheme = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(.*)$", 1)
    rest = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(.*)$", 2)
    return F.concat(F.lower(scheme), rest, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def normalize_protocol(u: Column, prefer_https: bool = True) -> Column:
    """Trimmed, with a scheme (https by preference) and a lower-case host."""
    t = F.trim(u)
    full = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(
        ~t.rlike(r"^https?://"), F.concat(F.lit("http://"), t)
    ).otherwise(t)
    if prefer_https:
        full = F.regexp_replace(full, r"^http://", "https://")
    at = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(.*)$"
    return F.concat(F.lower(F.regexp_extract(full, at, 1)), F.regexp_extract(full, at, 2))


def clean_url(u: Column) -> Column:
    """Whole pipeline: trim, decode, follow redirect, drop tracking, normalise, validate; null if invalid."""
    def valid(out: Column) -> Column:
        host = netloc_of(out)
        return F.when(host.contains(".") & (F.length(F.element_at(F.split(host, r"\."), -1)) >= 2), out)

    return staged(
        F.nullif(F.trim(u), F.lit("")),
        lambda t: F.when(t.contains("%") & (F.length(decode(t)) < F.length(t)), decode(t)).otherwise(t),
        lambda d: F.when(is_google_redirect(d), F.coalesce(redirect_target(d), d)).otherwise(d),
        remove_tracking,
        normalize_protocol,
        valid,
    )


def is_valid_url(u: Column) -> Column:
    """Scheme and host are present."""
    return F.coalesce((scheme_of(u) != "") & (netloc_of(u) != ""), F.lit(False))


def is_social_url(u: Column, domains: Sequence[str] = SOCIAL_DOMAINS, substring: bool = False) -> Column:
    """Host is one of the domains or below one; `substring` takes any host that contains one."""
    host = host_of(u)
    if substring:
        return F.coalesce(host.rlike("|".join(d.replace(".", r"\.") for d in domains)), F.lit(False))
    return F.coalesce(host.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"), F.lit(False))


def is_internal_link(u: Column, base: Column) -> Column:
    return ~u.rlike(r"(?i)^(javascript|mailto|tel):") & u.startswith(base)


def was_redirected(original: Column, final: Column) -> Column:
    """'true' / 'false' as the output file writes it."""
    return F.when((F.coalesce(original, F.lit("")) != "") & (F.coalesce(final, F.lit("")) != "") & (original != final), "true").otherwise("false")
