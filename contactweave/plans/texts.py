"""Queries of the scalar functions: URLs, extraction, validation, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions import classify, contacts, urls, validate
from contactweave.functions.common import country_code, duration_text, eta_text, formula_guard, sheet_value, split_list, strip_processed
from contactweave.functions.html_contacts import html_contact_links, html_contacts, html_facts, html_text
from contactweave.functions.phones import normalize_phone, validate_whatsapp
from contactweave.plans.registry import Registry
from contactweave.session import table
from contactweave.sources import readers

R = Registry()


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_input").filter(F.col("url").isNotNull()).select("listing_id", "url")


_SRC = "(SELECT listing_id, url AS u FROM sample_input WHERE url IS NOT NULL)"
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = "regexp_extract(regexp_replace({0}, '#.*$', ''), '\\?(.*)$', 1)"
_NETLOC = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def _redirect(u: str) -> str:
    return f"(contains({_PATH.format(u)}, '/url') AND contains({_QUERY.format(u)}, 'q='))"


def _dec(x: str) -> str:
    return f"url_decode({x})"


def _form(x: str) -> str:
    return f"url_decode(replace({x}, '+', '%20'))"


def _pairs(u: str) -> str:
    return f"""list_transform(list_filter(string_split({_QUERY.format(u)}, '&'), lambda p: p <> ''),
 lambda p: struct_pack(k := {_form("regexp_extract(p, '^([^=]*)', 1)")}, v := {_form("regexp_extract(p, '^[^=]*=(.*)$', 1)")}))"""


_TRACK = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)


def _untracked(u: str, source: str) -> str:
    """Subquery with `u2`: the URL without tracking."""
    return f"""(SELECT *, lower(regexp_extract(head, '^([A-Za-z][A-Za-z0-9+.\\-]*:)?(.*)$', 1)) || regexp_extract(head, '^([A-Za-z][A-Za-z0-9+.\\-]*:)?(.*)$', 2)
 || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u2 FROM (
 SELECT *, regexp_extract({u}, '^([^?#]*)', 1) AS head, array_to_string(list_transform(list_filter(kept, lambda p, i: list_position(list_transform(kept, lambda z: z.k), p.k) = i),
 lambda p: CASE WHEN p.v = '' THEN p.k ELSE p.k || '=' || p.v END), '&') AS q FROM (
 SELECT *, list_filter({_pairs(u)}, lambda p: lower(p.k) NOT IN ({_TRACK})) AS kept FROM {source})))"""


_AT = "'^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)(.*)$'"


def _protocol(u: str) -> str:
    t = f"trim({u})"
    full = f"regexp_replace(CASE WHEN starts_with({t}, '//') THEN 'https:' || {t} WHEN NOT regexp_matches({t}, '^https?://') THEN 'http://' || {t} ELSE {t} END, '^http://', 'https://')"
    return f"(lower(regexp_extract({full}, {_AT}, 1)) || regexp_extract({full}, {_AT}, 2))"


@R.add("url_is_redirect", f"SELECT listing_id, {_redirect('u')} AS is_redirect FROM {_SRC}")
def url_is_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("listing_id", urls.is_google_redirect(F.col("url")).alias("is_redirect"))


_TARGET = f"url_decode(list_filter({_pairs('u')}, lambda p: p.k = 'q' AND p.v <> '')[1].v)"


@R.add("url_redirect_target", f"SELECT listing_id, {_TARGET} AS target FROM {_SRC} WHERE {_redirect('u')}")
def url_redirect_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, sf_dir).filter(urls.is_google_redirect(u)).select("listing_id", urls.redirect_target(u).alias("target"))


@R.add("url_tracking", f"SELECT listing_id, u2 AS cleaned FROM {_untracked('u', _SRC)}")
def url_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("listing_id", urls.remove_tracking(F.col("url")).alias("cleaned"))


@R.add("url_protocol", f"SELECT listing_id, {_protocol('u')} AS normal FROM {_SRC}")
def url_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("listing_id", urls.normalize_protocol(F.col("url")).alias("normal"))


_DECODED = f"(SELECT listing_id, trim(u) AS t, CASE WHEN contains(u, '%') AND length(url_decode(trim(u))) < length(trim(u)) THEN url_decode(trim(u)) ELSE trim(u) END AS u FROM {_SRC})"
_FOLLOWED = f"(SELECT listing_id, t, CASE WHEN {_redirect('u')} THEN coalesce({_TARGET}, u) ELSE u END AS u FROM {_DECODED})"
_CLEAN = f"""(SELECT listing_id, CASE WHEN t <> '' AND contains({_NETLOC.format('c')}, '.') AND length(string_split({_NETLOC.format('c')}, '.')[-1]) >= 2 THEN c END AS clean
 FROM (SELECT listing_id, t, {_protocol('u2')} AS c FROM {_untracked('u', _FOLLOWED)}))"""


@R.add("url_clean", f"SELECT listing_id, clean FROM {_CLEAN}")
def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("listing_id", urls.clean_url(F.col("url")).alias("clean"))


@R.add(
    "url_cleanup_stats",
    f"""SELECT count(*) AS n, count(clean) AS valid, CAST(sum(length(u)) AS BIGINT) AS chars_before, CAST(coalesce(sum(length(clean)), 0) AS BIGINT) AS chars_after,
 count(*) FILTER (WHERE r) AS redirects FROM {_CLEAN} JOIN (SELECT listing_id, u, {_redirect('u')} AS r FROM {_SRC}) USING (listing_id)""",
)
def url_cleanup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, sf_dir).withColumn("clean", urls.clean_url(u)).agg(
        F.count("*").alias("n"), F.count("clean").alias("valid"), F.sum(F.length(u)).alias("chars_before"), F.coalesce(F.sum(F.length("clean")), F.lit(0)).alias("chars_after"),
        F.count(F.when(urls.is_google_redirect(u), 1)).alias("redirects"),
    )


_SOCIAL = "'(^|\\.)(social-one\\.example|photo-net\\.example|" + "|".join(d.replace(".", "\\.") for d in urls.SOCIAL_DOMAINS) + ")$'"


@R.add(
    "social_skip",
    f"""SELECT listing_id, regexp_matches(lower(regexp_replace(regexp_replace({_NETLOC.format('clean')}, '^.*@', ''), ':[0-9]*$', '')), {_SOCIAL}) AS social
 FROM {_CLEAN} WHERE clean IS NOT NULL""",
)
def social_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _urls(spark, sf_dir).select("listing_id", urls.clean_url(F.col("url")).alias("clean")).filter("clean IS NOT NULL")
    return clean.select("listing_id", urls.is_social_url(F.col("clean"), ("social-one.example", "photo-net.example", *urls.SOCIAL_DOMAINS)).alias("social"))


@R.add(
    "url_parts",
    f"SELECT listing_id, regexp_extract(clean, '^([a-z]+):', 1) || '://' || {_NETLOC.format('clean')} AS base, {_NETLOC.format('clean')} <> '' AS is_valid FROM {_CLEAN} WHERE clean IS NOT NULL",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _urls(spark, sf_dir).select("listing_id", urls.clean_url(F.col("url")).alias("c")).filter("c IS NOT NULL")
    return clean.select("listing_id", urls.base_url(F.col("c")).alias("base"), urls.is_valid_url(F.col("c")).alias("is_valid"))


@R.add("page_redirected", "SELECT page_id, CASE WHEN coalesce(url, '') <> '' AND coalesce(final_url, '') <> '' AND url <> final_url THEN 'true' ELSE 'false' END AS was_redirected FROM pages")
def page_redirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.was_redirected(F.col("url"), F.col("final_url")).alias("was_redirected"))


_EMAIL = contacts.EMAIL_PATTERN
_MAILS = f"list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda e: lower(e))"


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


@R.add("doc_emails", f"SELECT doc_id, array_to_string({_ordered_distinct(_MAILS)}, ',') AS emails FROM documents WHERE text IS NOT NULL")
def doc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.array_join(contacts.emails_in(F.col("text")), ",").alias("emails"))


@R.add("doc_text_emails")
def doc_text_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.array_join(contacts.text_emails(F.col("text")), ",").alias("emails"))


_FLAT = "(SELECT id, unnest(emails) AS e FROM zen_contacts)"
_LOCALS = ", ".join(f"'{x}'" for x in contacts.PLACEHOLDER_LOCALS)
_DOMAINS = ", ".join(f"'{x}'" for x in contacts.PLACEHOLDER_DOMAINS)


@R.add(
    "email_placeholder",
    f"""SELECT id, e AS email, (NOT contains(e, '@')) OR lower(trim(regexp_extract(e, '^[^@]*@(.*)$', 1))) IN ({_DOMAINS})
 OR lower(trim(regexp_extract(e, '^([^@]*)@', 1))) IN ({_LOCALS}) OR ends_with(lower(trim(e)), '.example') OR ends_with(lower(trim(e)), '.invalid') AS placeholder
 FROM {_FLAT} WHERE e IS NOT NULL""",
)
def email_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "zen_contacts").select("id", F.explode("emails").alias("email")).filter("email IS NOT NULL")
    return e.select("id", "email", contacts.is_placeholder_email(F.col("email")).alias("placeholder"))


_L = "lower(regexp_extract(e, '^([^@]*)@', 1))"
_TOK = f"list_filter(regexp_split_to_array({_L}, '[._+-]+'), lambda t: t <> '')"


@R.add(
    "email_plausible",
    f"""SELECT id, e AS email, {_L} <> '' AND NOT (length({_L}) > 64 OR regexp_matches({_L}, '^[.\\-]|[.\\-]$') OR regexp_matches({_L}, 'email|mailto|whatsapp|phone|address')
 OR regexp_matches({_L}, '^[a-z]{{2}}[0-9]') OR regexp_matches({_L}, '[0-9]{{3}}-?[0-9]{{3}}-?[0-9]{{4}}.*[a-z]{{2,}}$')
 OR len(list_filter({_TOK}, lambda t: len(list_filter({_TOK}, lambda u: u = t)) >= 3)) > 0
 OR regexp_matches({_L}, '{"|".join(c + "{4,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")}') OR regexp_matches({_L}, '^[0-9]{{9,}}$')) AS plausible
 FROM {_FLAT} WHERE e IS NOT NULL""",
)
def email_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "zen_contacts").select("id", F.explode("emails").alias("email")).filter("email IS NOT NULL")
    return e.select("id", "email", contacts.is_plausible_local(F.regexp_extract("email", r"^([^@]*)@", 1)).alias("plausible"))


_FORM = "(regexp_full_match(e, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AND length(regexp_extract(e, '^([^@]*)@', 1)) <= 64 AND NOT contains(e, '..'))"
_D = "regexp_extract(e, '@(.*)$', 1)"
_BIG = ", ".join(f"'{x}'" for x in validate.BIG_PROVIDERS)
_PH = ", ".join(f"'{x}'" for x in validate.PLACEHOLDER_DOMAINS)
_FAKE = f"({_FORM} AND ({_D} IN ({_PH}) OR regexp_matches({_D}, '{'|'.join(validate.PLACEHOLDER_PARTS)}') OR ends_with({_D}, '.local') OR ends_with({_D}, '.test') OR ends_with({_D}, '.invalid')))"


@R.add(
    "email_validation",
    f"""WITH m AS (SELECT listing_id, lower(trim(email)) AS e FROM sample_input WHERE email IS NOT NULL)
 SELECT listing_id, {_FORM} AND NOT {_FAKE} AS valid, CASE WHEN NOT {_FORM} THEN 'invalid_format' WHEN {_FAKE} THEN 'placeholder_domain' ELSE 'not_probed' END AS reason,
 CASE WHEN NOT {_FORM} OR {_FAKE} THEN 'high' ELSE 'unknown' END AS confidence, {_FORM} AND {_D} IN ({_BIG}) AS big FROM m""",
)
def email_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").filter(F.col("email").isNotNull())
    v = s.select("listing_id", validate.validate_email(F.col("email")).alias("v"))
    return v.select("listing_id", "v.valid", "v.reason", "v.confidence", F.col("v.is_big_provider").alias("big"))


@R.add("email_batch_map", "SELECT id, len(list_distinct(list_filter(list_transform(emails, lambda e: lower(trim(e))), lambda e: e IS NOT NULL AND e <> '')))::INTEGER AS checked FROM zen_contacts WHERE emails IS NOT NULL")
def email_batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").filter("emails IS NOT NULL")
    return z.select("id", F.size(F.map_keys(validate.validate_batch(F.col("emails")))).alias("checked"))


def _ladder(rows: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in rows) + f" ELSE '{default}' END"


_ERR = "lower(scrape_error)"


def _has(w: str) -> str:
    return f"contains({_ERR}, '{w}')"


_CAT = _ladder(
    [
        (f"{_has('mailbox')} AND ({_has('not')} OR {_has('invalid')})", "mailbox_not_found"), (f"{_has('domain')} AND ({_has('not')} OR {_has('invalid')})", "domain_not_found"),
        (_has("mx"), "mx_not_found"), (_has("timeout"), "smtp_timeout"), (_has("connection"), "connection_refused"), (f"{_has('blocked')} OR {_has('spam')}", "blocked"),
        (_has("greylist"), "greylisted"), (f"{_has('quota')} OR {_has('full')}", "mailbox_full"),
    ],
    "smtp_invalid",
)
_REASON = _ladder(
    [
        (_has("timeout"), "smtp_timeout"), (f"{_has('connection')} OR {_has('refused')}", "connection_refused"), (f"{_has('mx')} OR {_has('dns')}", "mx_not_found"),
        (f"{_has('blocked')} OR {_has('blacklist')}", "blocked"), (_has("greylist"), "greylisted"), (_has("disposable"), "disposable_email"),
    ],
    "smtp_error",
)


@R.add("error_categories", f"SELECT id, {_CAT} AS category, {_REASON} AS reason FROM zen_contacts WHERE scrape_error IS NOT NULL")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").filter("scrape_error IS NOT NULL")
    return z.select("id", validate.error_category(F.col("scrape_error")).alias("category"), validate.exception_reason(F.col("scrape_error")).alias("reason"))


def _q(p: str) -> str:
    return p.replace("'", "''")


_SSL_IS = f"(regexp_matches({_ERR}, '{'|'.join(classify.SSL_WORDS)}') AND (contains({_ERR}, 'error') OR contains(scrape_error, 'SEC_') OR contains(scrape_error, 'SSL_')))"
_SSL = f"CASE WHEN NOT {_SSL_IS} THEN 'not_ssl_error' " + " ".join(f"WHEN regexp_matches(scrape_error, '(?i){_q(p)}') THEN '{n}'" for n, p in classify.SSL_CLASSES) + " ELSE 'unknown_ssl_error' END"


@R.add("ssl_classify", f"SELECT id, {_SSL} AS error_type FROM zen_contacts WHERE scrape_error IS NOT NULL")
def ssl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").filter("scrape_error IS NOT NULL")
    return z.select("id", classify.ssl_class(F.col("scrape_error")).alias("error_type"))


def _hits(words, col: str) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{_q(w)}') AS INTEGER)" for w in words) + ")"


_LOW = "lower(html)"
_CHALLENGE = f"""CASE WHEN html IS NULL OR html = '' THEN true WHEN length(html) > 10000 THEN false WHEN {_hits(classify.STRONG_WAIT, _LOW)} >= 1 THEN true
 WHEN {_hits(classify.WEAK_WAIT, _LOW)} >= 3 AND length(html) < 5000 THEN true ELSE contains({_LOW}, 'cloudflare') AND length(html) < 2000 END"""


@R.add("challenge_detect", f"SELECT page_id, {_CHALLENGE} AS challenge FROM pages")
def challenge_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", classify.looks_like_challenge(F.col("html")).alias("challenge"))


_E = "lower(coalesce(fetch_error, ''))"
_H = "lower(coalesce(html, ''))"
_NEED = _ladder(
    [
        (f"contains({_E}, 'cloudflare wait page') AND contains({_E}, 'persisted')", "CF_wait_exceeded"), (f"contains({_E}, 'cloudflare challenge')", "CF_challenge"),
        (f"contains({_E}, 'timeout') AND NOT contains({_E}, 'cloudflare') AND coalesce(load_seconds, 0) >= 50", "long_timeout"),
        (f"contains({_E}, 'timeout') AND NOT contains({_E}, 'cloudflare')", "quick_timeout"), (f"contains({_E}, 'dynamic_fetch_timeout')", "dynamic_timeout"),
        ("status_code = 403", "forbidden_403"), ("status_code = 429", "rate_limited_429"), ("status_code = 503", "service_unavailable_503"),
        ("status_code = 408 AND coalesce(load_seconds, 0) >= 60", "timeout_408_long"), ("status_code = 408", "timeout_408_quick"),
        (f"{_hits(classify.WAIT_CONTENT, _H)} > 0", "CF_detected_content"), (f"{_hits(classify.ANTIBOT_CONTENT, _H)} > 0", "antibot_detected"),
        ("length(coalesce(html, '')) BETWEEN 1 AND 199", "small_html"),
    ],
    "no_proxy_needed",
)


@R.add("proxy_need", f"SELECT page_id, {_NEED} AS reason FROM pages")
def proxy_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    need = classify.proxy_need(F.col("fetch_error"), F.col("status_code"), F.col("load_seconds"), F.col("html"), F.lit(False))
    return p.select("page_id", need["reason"].alias("reason"))


_WORDS, _ASKS = "|".join(classify.CONTACT_WORDS), "|".join(classify.FORM_WORDS)
_TITLE = "replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&#x27;', chr(39)), '&amp;', '&')"
_BARE = "regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"


@R.add(
    "contact_pages",
    f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS description,
 coalesce(regexp_matches(lower(url), '{_WORDS}'), false) OR regexp_matches(lower({_TITLE}), '{_WORDS}')
 OR len(list_filter(regexp_extract_all({_BARE}, '(?is)<h[123][^>]*>(.*?)</h[123]>', 1), lambda x: regexp_matches(lower(regexp_replace(x, '<[^>]*>', '', 'g')), '{_WORDS}'))) > 0
 OR len(list_filter(regexp_extract_all({_BARE}, '(?is)<form[^>]*>(.*?)</form>', 1), lambda x: regexp_matches(lower(regexp_replace(x, '<[^>]*>', '', 'g') || ' ' ||
 array_to_string(regexp_extract_all(x, '(?:name|placeholder|id)="([^"]*)"', 1), ' ')), '{_ASKS}'))) > 0 AS contact FROM pages WHERE html <> ''""",
)
def contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter("html <> ''").withColumn("f", html_facts("html"))
    contact = classify.is_contact_page(F.col("html"), F.col("url"), F.col("f.title"), F.col("f.headings"), F.col("f.forms"))
    return p.select("page_id", F.col("f.title").alias("title"), F.col("f.description").alias("description"), contact.alias("contact"))


@R.add("html_contacts")
def html_contacts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter(F.length("html") > 0)
    return p.select("page_id", F.explode(html_contacts("html")).alias("c")).select("page_id", "c.*")


@R.add("html_text_length")
def html_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(html_text("html")).alias("n_chars"))


@R.add("html_contact_links")
def html_contact_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter(F.length("html") > 0)
    return p.select("page_id", F.explode(html_contact_links("html", "url")).alias("link"))


@R.add(
    "source_rows",
    """WITH d AS (SELECT id, TRY_CAST(data AS JSON) AS j FROM results)
 SELECT id AS result_id, trim(j->>'$.link') AS link, trim(j->>'$.web_site') AS url, trim(j->>'$.title') AS title,
 coalesce(upper(substr(nullif(trim(j->>'$.complete_address.country'), ''), 1, 2)), 'XX') AS country,
 coalesce(nullif(CAST(j->>'$.longtitude' AS DOUBLE), 0), CAST(j->>'$.longitude' AS DOUBLE)) AS longitude FROM d
 WHERE j IS NOT NULL AND trim(coalesce(j->>'$.link', '')) <> '' AND trim(coalesce(j->>'$.web_site', '')) <> ''""",
)
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.parse_results(table(spark, sf_dir, "results"))
    return rows.select("result_id", "link", "url", "title", "country", "longitude")


@R.add(
    "string_tools",
    """SELECT listing_id, array_to_string(list_filter(list_transform(string_split(google_business_categories, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items,
 CASE WHEN regexp_matches(phone_number, '^[=+\\-@]') THEN '''' || phone_number ELSE phone_number END AS guarded,
 CASE WHEN name IS NULL OR lower(trim(name)) IN ('nan', 'none', 'null', '-') THEN '' ELSE name END AS shown,
 upper(substr(coalesce(country_code, 'XX'), 1, 2)) AS country, regexp_replace(replace(batch_file, '.csv', '_processed'), '_processed$', '') AS stem
 FROM sample_input""",
)
def string_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cats = F.when(c("google_business_categories").isNotNull(), F.array_join(split_list(c("google_business_categories")), "|"))
    return table(spark, sf_dir, "sample_input").select(
        "listing_id", cats.alias("items"), formula_guard(c("phone_number")).alias("guarded"), sheet_value(c("name")).alias("shown"),
        country_code(c("country_code")).alias("country"), strip_processed(F.replace(c("batch_file"), F.lit(".csv"), F.lit("_processed"))).alias("stem"),
    )


@R.add(
    "durations",
    """SELECT id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, (s % 3600) // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%.1fs', CAST(s AS DOUBLE)) END AS took,
 CASE WHEN m IS NULL THEN 'N/A' WHEN m < 1 THEN '<1min' WHEN m < 60 THEN printf('%dmin', m) ELSE printf('%dh%02dm', m // 60, m % 60) END AS eta
 FROM (SELECT id, gmaps_review_count * 7 AS s, CAST(gmaps_review_count AS BIGINT) AS m FROM zen_contacts WHERE gmaps_review_count IS NOT NULL)""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").filter("gmaps_review_count IS NOT NULL")
    n = F.col("gmaps_review_count")
    return z.select("id", duration_text(n * 7).alias("took"), eta_text(n.cast("long")).alias("eta"))
