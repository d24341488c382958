"""Queries of operators that stand behind others: clean-up ladders, probe mappings, structured data, endpoints, rows for the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions import classify, common, contacts, phones, validate
from contactweave.functions.html_contacts import HtmlLinks, JsonLdContacts, html_contacts
from contactweave.operators import dashboard, merging, postprocess
from contactweave.plans.registry import Registry
from contactweave.plans.reports import NOW
from contactweave.plans.shaping import _processed
from contactweave.session import table
from contactweave.sources import readers

R = Registry()


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


# ---------------------------------------------------------------- e-mail and phone text
_CAPTURE = "([a-z0-9._%+-]+)@([a-z0-9.-]+)\\.([a-z]{2,})(?:[^a-z]|$)"
_NORMAL = f"""WITH c AS (SELECT listing_id, email, lower(regexp_replace(regexp_replace(trim(email), '^[<>]+|[<>]+$', '', 'g'), '^["'']+|["'']+$', '', 'g')) AS c FROM sample_input WHERE email IS NOT NULL),
 p AS (SELECT *, regexp_extract(c, '{_CAPTURE}', 1) AS n0, regexp_extract(c, '{_CAPTURE}', 2) AS d0, regexp_extract(c, '{_CAPTURE}', 3) AS e0 FROM c),
 q AS (SELECT *, CASE WHEN regexp_matches(n0, '^[0-9]+[._-]') THEN regexp_replace(n0, '^(?:[0-9]+[._-]*)+', '') ELSE n0 END AS n1,
  regexp_replace(regexp_replace(d0, '^[.-]+|[.-]+$', '', 'g'), '\\.{{2,}}', '.', 'g') AS d, regexp_extract(e0, '^({_any(contacts.COMMON_TLDS)})[a-z]+$', 1) AS base FROM p),
 r AS (SELECT *, regexp_extract(n1, '({_any(contacts.ALIASES)})$', 1) AS alias, CASE WHEN base = '' OR e0 IN ({_in((*contacts.COMMON_TLDS, *contacts.LONGER_TLDS))}) THEN e0 ELSE base END AS e FROM q),
 s AS (SELECT *, substr(n1, 1, length(n1) - length(alias)) AS front FROM r),
 t AS (SELECT *, CASE WHEN alias <> '' AND (regexp_matches(front, '[0-9._-]') OR front IN ({_in((*contacts.PAGE_WORDS, *contacts.COUNTRY_PREFIXES))})) THEN alias ELSE n1 END AS n FROM s)
 SELECT listing_id, email, CASE WHEN n <> '' AND d <> '' AND e0 NOT IN ({_in(contacts.FILE_ENDINGS)}) AND length(e) <= 10
  AND len(list_filter(string_split(d || '.' || e, '.'), lambda w: regexp_full_match(w, '(?:{"|".join(contacts.GLUED_TLDS)})[a-z]{{1,5}}') AND w NOT IN ({_in(contacts.DOMAIN_WORDS)}))) = 0
  AND NOT (regexp_matches(n, '^[0-9]') AND (regexp_matches(n, '^[0-9]{{4}}') OR length(regexp_replace(n, '[^0-9]', '', 'g')) * 2 > length(n))) THEN n || '@' || d || '.' || e END AS normal FROM t"""


@R.add("email_normalized", _NORMAL)
def email_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").filter(F.col("email").isNotNull())
    return s.select("listing_id", "email", contacts.normalize_email(F.col("email")).alias("normal"))


_FOUND = f"list_filter(list_transform(regexp_extract_all(text, '{contacts.PHONE_PATTERN}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 7)"


@R.add("doc_phones", f"SELECT doc_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') AS phones FROM (SELECT doc_id, {_FOUND} AS f FROM documents WHERE text IS NOT NULL)")
def doc_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.array_join(contacts.phones_in(F.col("text")), "|").alias("phones"))


_DEOBFUSCATED = "text"
for _p, _sign in contacts.DEOBFUSCATION:
    _DEOBFUSCATED = f"regexp_replace({_DEOBFUSCATED}, '(?i){_p}', '{_sign}', 'g')"


@R.add("deobfuscated", f"SELECT doc_id, md5({_DEOBFUSCATED}) AS meant FROM documents WHERE text IS NOT NULL")
def deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(contacts.deobfuscate(F.col("text"))).alias("meant"))


_REGIONS = ", ".join(f"('{r}', '{c}', {lo}, {hi}, '{m}')" for r, (c, lo, hi, m) in phones.REGIONS.items())
_PARSED = f"""reg(region, code, lo, hi, mob) AS (VALUES {_REGIONS}),
 a AS (SELECT id, raw, home, regexp_replace(regexp_replace(trim(raw), '(?i)(?:ext|x)\\.?\\s*[0-9]+\\s*$', ''), '\\(0\\)', '', 'g') AS s FROM src WHERE trim(coalesce(raw, '')) <> ''),
 b AS (SELECT *, starts_with(ltrim(s, '( '), '+') OR starts_with(s, '00') AS plus, CASE WHEN starts_with(s, '00') THEN substr(regexp_replace(s, '[^0-9]', '', 'g'), 3) ELSE regexp_replace(s, '[^0-9]', '', 'g') END AS digits FROM a),
 c AS (SELECT *, CASE WHEN plus THEN (SELECT arg_min(region, (-length(code), n)) FROM (SELECT *, row_number() OVER () AS n FROM reg) WHERE starts_with(digits, code)) ELSE home END AS land FROM b),
 d AS (SELECT c.*, reg.*, CASE WHEN plus THEN substr(digits, length(code) + 1) WHEN land = 'IT' THEN digits ELSE ltrim(digits, '0') END AS nat FROM c LEFT JOIN reg ON region = land),
 e AS (SELECT *, CASE WHEN region IS NULL AND plus THEN 'unknown_region' WHEN land IS NULL THEN 'no_country' WHEN region IS NULL THEN 'unknown_region' WHEN length(nat) NOT BETWEEN lo AND hi THEN 'invalid_format' ELSE 'valid' END AS reason FROM d),
 f AS (SELECT *, CASE WHEN reason <> 'valid' THEN 'unknown' WHEN starts_with(nat, '800') THEN 'toll_free' WHEN mob = '' OR regexp_matches(nat, '^(?:' || mob || ')') THEN 'mobile' ELSE 'fixed_line' END AS kind FROM e)"""


@R.add(
    "phones_normalized",
    f"""WITH src AS (SELECT listing_id AS id, phone_number AS raw, upper(trim(country_code)) AS home FROM sample_input WHERE phone_number IS NOT NULL), {_PARSED}
 SELECT id AS listing_id, CASE reason WHEN 'unknown_region' THEN CASE WHEN plus THEN '+' || digits ELSE digits END WHEN 'no_country' THEN digits ELSE '+' || code || nat END AS e164,
 CASE WHEN region IS NULL AND plus THEN '' ELSE coalesce(land, '') END AS region, kind, reason FROM f
 UNION ALL SELECT id, '', '', 'unknown', 'empty_number' FROM src WHERE trim(raw) = ''""",
)
def phones_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_input").filter("phone_number IS NOT NULL")
    return s.select("listing_id", phones.normalize_phone("phone_number", F.upper(F.trim("country_code"))).alias("p")).select("listing_id", "p.*")


@R.add(
    "whatsapp_check",
    f"""WITH src AS (SELECT id, n AS raw, CASE WHEN regexp_full_match(k, '[A-Z]{{2}}') THEN k END AS home FROM (SELECT id, unnest(whatsapp) AS n, upper(trim(country_code)) AS k FROM zen_contacts)), {_PARSED}
 SELECT id, raw AS n, kind = 'mobile' AS valid, CASE WHEN reason = 'valid' THEN land ELSE '' END AS country, kind AS type, CASE WHEN reason <> 'valid' THEN reason WHEN kind = 'mobile' THEN 'valid' ELSE 'not_mobile' END AS reason FROM f
 UNION ALL SELECT id, raw, false, '', 'unknown', 'empty_number' FROM src WHERE trim(coalesce(raw, '')) = ''""",
)
def whatsapp_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every messenger number with the region of its row."""
    land = F.upper(F.trim("country_code"))
    z = table(spark, sf_dir, "zen_contacts").select("id", F.when(land.rlike("^[A-Z]{2}$"), land).alias("land"), F.explode("whatsapp").alias("n"))
    return z.select("id", "n", phones.validate_whatsapp("n", "land").alias("w")).select("id", "n", "w.valid", "w.country", "w.type", "w.reason")


@R.add("hex_emails", "SELECT id, e AS decoded FROM (SELECT id, unnest(emails) AS e FROM zen_contacts) WHERE regexp_full_match(e, '[ -~]+')")
def hex_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses coded by XOR with their first byte and decoded again."""
    e = table(spark, sf_dir, "zen_contacts").select("id", F.explode("emails").alias("e")).filter(F.col("e").rlike("^[ -~]+$"))
    letters = F.filter(F.split("e", ""), lambda c: c != "")
    code = F.concat(F.lit("2a"), F.array_join(F.transform(letters, lambda c: F.lower(F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.lit(42))), 2, "0"))), ""))
    return e.select("id", contacts.hex_email(code).alias("decoded"))


@R.add("messenger_links", "SELECT id, '+' || regexp_replace(n, '[^0-9]', '', 'g') AS number FROM (SELECT id, unnest(whatsapp) AS n FROM zen_contacts) WHERE length(regexp_replace(n, '[^0-9]', '', 'g')) > 0")
def messenger_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found again in links made of them, in one of three forms."""
    w = table(spark, sf_dir, "zen_contacts").select("id", F.explode("whatsapp").alias("n")).withColumn("d", F.regexp_replace("n", r"\D", "")).filter("d <> ''")
    form = F.pmod("id", F.lit(3))
    link = F.when(form == 0, F.concat(F.lit("https://wa.me/"), "d")).when(form == 1, F.concat(F.lit("https://api.whatsapp.com/send?phone=+"), "d")).otherwise(F.concat(F.lit("whatsapp://send?phone="), "d"))
    return w.select("id", F.explode(contacts.messenger_numbers(link)).alias("number"))


@R.add("social_handles", "SELECT id, nullif(regexp_extract(social_facebook, '" + contacts.SOCIAL_PATTERNS["facebook"] + "', 1), '') AS facebook, nullif(regexp_extract(social_instagram, '" + contacts.SOCIAL_PATTERNS["instagram"] + "', 1), '') AS instagram FROM zen_contacts")
def social_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_contacts").select("id", *[contacts.social_handle(F.col(f"social_{p}"), p).alias(p) for p in ("facebook", "instagram")])


_LOCAL, _DOMAIN = "regexp_extract({0}, '^([^@]*)@', 1)", "regexp_extract({0}, '@(.*)$', 1)"


@R.add(
    "email_variants",
    f"""SELECT id, array_to_string(list_filter(emails, lambda e: len(list_filter(emails, lambda s: {_DOMAIN.format('s')} = {_DOMAIN.format('e')} AND length({_LOCAL.format('s')}) < length({_LOCAL.format('e')})
 AND {_LOCAL.format('s')} <> '' AND contains({_LOCAL.format('e')}, {_LOCAL.format('s')}) AND contains({_LOCAL.format('e')}, 'email'))) = 0), ',') AS kept
 FROM (SELECT id, list_concat(emails, list_transform(emails, lambda e: 'email' || e)) AS emails FROM zen_contacts WHERE len(emails) > 0)""",
)
def email_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a glued copy of each beside them: only the copies go."""
    z = table(spark, sf_dir, "zen_contacts").filter(F.size("emails") > 0)
    doubled = F.concat("emails", F.transform("emails", lambda e: F.concat(F.lit("email"), e)))
    return z.select("id", F.array_join(contacts.drop_variants(doubled), ",").alias("kept"))


@R.add("digit_shares", "SELECT listing_id, round(length(regexp_replace(phone_number, '[^0-9]', '', 'g')) / nullif(length(phone_number), 0)::DOUBLE, 6) AS share FROM sample_input WHERE phone_number IS NOT NULL")
def digit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_input").filter("phone_number IS NOT NULL").select("listing_id", F.round(contacts.digits_ratio(F.col("phone_number")), 6).alias("share"))


# ---------------------------------------------------------------- pages
_HREFS = "regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)"


@R.add(
    "page_links",
    f"""SELECT page_id, h AS href, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || h ELSE h END AS link FROM (SELECT page_id, url, unnest({_HREFS}) AS h FROM pages WHERE regexp_matches(url, '^https?://'))
 WHERE starts_with(h, '/') OR regexp_matches(h, '^(https?|mailto|tel):')""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page by the table function, made absolute."""
    spark.udtf.register("html_links_of", HtmlLinks)
    table(spark, sf_dir, "pages").filter("url RLIKE '^https?://'").createOrReplaceTempView("pages_with_links")
    got = spark.sql("SELECT page_id, p.url, l.href AS link FROM pages_with_links p, LATERAL html_links_of(p.html, p.url) l")
    root = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    rel = F.col("link").startswith(F.concat(root, F.lit("/")))
    # the raw address is the absolute one without the page's root, unless it was written out
    raw = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    pages = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    short = F.substring("link", F.length(root) + 1, F.lit(1 << 30))
    return got.join(pages, "page_id").select("page_id", F.when(rel & F.array_contains("raw", short), short).otherwise(F.col("link")).alias("href"), "link").filter(
        F.col("href").startswith("/") | F.col("href").rlike("^(https?|mailto|tel):")
    )


@R.add(
    "page_first_contacts",
    f"""SELECT page_id, field, value FROM (SELECT page_id, CASE WHEN starts_with(h, 'mailto:') THEN 'email' ELSE 'phone' END AS field, CASE WHEN starts_with(h, 'mailto:') THEN lower(substr(h, 8)) ELSE substr(h, 5) END AS value
 FROM (SELECT page_id, unnest({_HREFS}) AS h FROM pages) WHERE regexp_matches(h, '^(mailto|tel):[^?,]+$')) GROUP BY ALL""",
)
def page_first_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses and numbers that pages give in links."""
    p = table(spark, sf_dir, "pages").filter(F.length("html") > 0)
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="((?:mailto|tel):[^"?,]+)"'), F.lit(1))
    given = F.transform(hrefs, lambda h: F.when(h.startswith("mailto:"), F.lower(F.substring(h, F.lit(8), F.length(h)))).otherwise(F.substring(h, F.lit(5), F.length(h))))
    got = p.select("page_id", given.alias("given"), F.explode(html_contacts("html")).alias("c")).filter(F.col("c.field").isin("email", "phone") & F.array_contains("given", F.col("c.value")))
    return got.select("page_id", "c.field", "c.value").distinct()


_LD = "regexp_extract_all(html, '(?s)<script[^>]*ld\\+json[^>]*>(.*?)</script>', 1)"


@R.add(
    "page_json_ld",
    f"""WITH b AS (SELECT page_id, TRY_CAST(unnest({_LD}) AS JSON) AS j FROM pages)
 SELECT page_id, 'email' AS field, j->>'$.email' AS value FROM b WHERE j->>'$.email' IS NOT NULL UNION ALL SELECT page_id, 'phone', j->>'$.telephone' FROM b WHERE j->>'$.telephone' IS NOT NULL""",
)
def page_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("json_ld_contacts", JsonLdContacts)
    table(spark, sf_dir, "pages").filter(F.length("html") > 0).createOrReplaceTempView("pages_with_data")
    return spark.sql("SELECT page_id, j.field, j.value FROM pages_with_data p, LATERAL json_ld_contacts(p.html) j").filter(F.col("field").isin("email", "phone"))


@R.add("html_like", "SELECT page_id, coalesce(regexp_matches(html, '<[^>]+>') AND NOT regexp_matches(html, '^[A-Za-z][A-Za-z0-9+.\\-]*:'), false) AS html_like FROM pages")
def html_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", classify.is_html_like(F.col("html")).alias("html_like"))


@R.add("decoded_texts", "SELECT doc_id, md5(text) AS decoded FROM documents WHERE text IS NOT NULL")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts turned into bytes and back, the encoding being found."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(readers.decode_udf(F.encode("text", "UTF-8"), F.lit(None).cast("string"))["text"]).alias("decoded"))


# ---------------------------------------------------------------- decisions
def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


_E = "coalesce(scrape_error, '')"
_IS_SSL = f"(regexp_matches(lower({_E}), '{'|'.join(classify.SSL_WORDS)}') AND (contains(lower({_E}), 'error') OR contains({_E}, 'SEC_') OR contains({_E}, 'SSL_')))"
_KIND = _case([(f"NOT {_IS_SSL}", "'not_ssl_error'"), *[(f"regexp_matches({_E}, '(?i){p.replace(chr(39), chr(39) * 2)}')", f"'{n}'") for n, p in classify.SSL_CLASSES]], "'unknown_ssl_error'")
_REC = lambda i: _case([(f"k = '{n}'", str(r[i]).lower()) for n, r in classify.RECOVERY.items()], str(classify.RECOVERY_ELSE[i]).lower())


@R.add(
    "ssl_details",
    f"""SELECT id, k <> 'not_ssl_error' AS is_ssl_error, k AS error_type, regexp_extract(e, '(SEC_ERROR_[0-9A-Za-z_]+|SSL_ERROR_[0-9A-Za-z_]+)', 1) AS code, regexp_extract(e, '(?i)doesn''t match (?:either of )?''([^'']+)''', 1) AS expected_host,
 {_REC(0)} AS skip, {_REC(1)} AS other_route, {_REC(2)} AS retries, {_REC(3)} AS extra_seconds FROM (SELECT id, {_E} AS e, {_KIND} AS k FROM zen_contacts)""",
)
def ssl_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "zen_contacts").select("id", F.coalesce("scrape_error", F.lit("")).alias("e"))
    return z.select("id", classify.ssl_details(F.col("e")).alias("d")).select("id", "d.*")


@R.add("browser_errors", "SELECT id, CASE WHEN c <> '' THEN 'ssl_certificate (' || c || ')' END AS kind FROM (SELECT id, regexp_extract(scrape_error, '(SEC_ERROR_[0-9A-Za-z_]+|SSL_ERROR_[0-9A-Za-z_]+)', 1) AS c FROM zen_contacts WHERE scrape_error IS NOT NULL)")
def browser_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_contacts").filter("scrape_error IS NOT NULL").select("id", classify.browser_error_type(F.col("scrape_error")).alias("kind"))


_REASONS = ("CF_wait_exceeded", "CF_challenge", "CF_detected_content", "antibot_detected", "explicit_proxy_flag", "connection_refused", "dns_error", "forbidden_403", "quick_timeout")
_REASON = "(" + _case([(f"page_id % {len(_REASONS)} = {i}", f"'{r}'") for i, r in enumerate(_REASONS)], "''") + ")"


@R.add(
    "retry_plans",
    f"""SELECT page_id, r AS reason, CASE WHEN r IN ('CF_wait_exceeded', 'CF_challenge', 'CF_detected_content', 'explicit_proxy_flag') THEN 'challenge' WHEN r IN ('connection_refused', 'dns_error', 'invalid_url') THEN 'dead_site' ELSE 'normal' END AS budget,
 CASE WHEN r IN ('CF_wait_exceeded', 'CF_challenge', 'CF_detected_content', 'antibot_detected') THEN 2 WHEN r IN ('connection_refused', 'dns_error', 'invalid_url') THEN 1 ELSE 3 END AS retries,
 CASE WHEN r IN ('CF_wait_exceeded', 'CF_challenge', 'CF_detected_content') THEN 60 WHEN r = 'antibot_detected' THEN 50 ELSE 25 END AS retry_seconds FROM (SELECT page_id, {_REASON} AS r FROM pages)""",
)
def retry_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for every reason, given out by the page's number."""
    reason = F.element_at(F.array(*[F.lit(r) for r in _REASONS]), (F.pmod("page_id", F.lit(len(_REASONS))) + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))
    return p.select("page_id", "reason", classify.retry_plan(F.col("reason")).alias("p")).select("page_id", "reason", "p.*")


_SNIP = "substr(html, 1, 4096)"
_HITS = lambda words: f"len(list_filter([{_in(words)}], lambda w: contains(lower({_SNIP}), w)))"
_SMALL = f"""CASE WHEN html IS NULL OR html = '' THEN true WHEN length({_SNIP}) > 10000 THEN false WHEN {_HITS(classify.STRONG_WAIT)} >= 1 THEN true
 WHEN {_HITS(classify.WEAK_WAIT)} >= 3 AND length({_SNIP}) < 5000 THEN true ELSE contains(lower({_SNIP}), 'cloudflare') AND length({_SNIP}) < 2000 END"""
_CF = "page_id % 2 = 0"


@R.add(
    "wait_pages",
    f"""SELECT page_id, CASE WHEN {_CF} AND status_code IN (403, 429, 503) THEN true WHEN {_SMALL} THEN true
 ELSE {_CF} AND length({_SNIP}) < 2048 AND (NOT contains(lower({_SNIP}), '<body') OR contains(lower({_SNIP}), 'content="0;url=')) END AS wait FROM pages""",
)
def wait_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over pages of which every second one names a known front server."""
    server = F.when(F.pmod("page_id", F.lit(2)) == 0, "cloudflare").otherwise("nginx")
    return table(spark, sf_dir, "pages").select("page_id", classify.wait_page(F.col("status_code"), server, F.lit(False), F.lit("text/html"), F.col("html")).alias("wait"))


_STATUS = "CASE WHEN trim(coalesce(url, '')) = '' THEN 'error' WHEN regexp_matches(url, 'social|photo') THEN 'skipped_social' WHEN email IS NOT NULL OR phone_number IS NOT NULL THEN 'success' WHEN country_code IS NULL THEN 'failed' ELSE 'no_contacts_found' END"


@R.add("scrape_statuses", f"SELECT listing_id, {_STATUS} AS status FROM sample_input")
def scrape_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rule with stand-ins for what a fetch gives: filled fields count as contacts, a missing country as the error."""
    s = table(spark, sf_dir, "sample_input")
    found = F.when(F.col("email").isNotNull() | F.col("phone_number").isNotNull(), 1).otherwise(0)
    error = F.when(F.col("country_code").isNull(), "failed")
    return s.select("listing_id", classify.scrape_status(F.col("url"), F.coalesce(F.col("url").rlike("social|photo"), F.lit(False)), error, found).alias("status"))


# ---------------------------------------------------------------- validation of probes
_ACCEPTED = "CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END"
_WORDS = ("VALID", "PROBABLY_VALID", "INVALID_FORMAT", "INVALID_DOMAIN", "DISPOSABLE", "OTHER")


@R.add(
    "probe_outcomes",
    f"""SELECT id, coalesce(a, true) AS valid, CASE WHEN a IS NULL THEN 'possibly_valid' WHEN NOT a THEN 'smtp_invalid' WHEN c THEN 'catch_all' ELSE 'valid' END AS reason,
 CASE WHEN a IS NULL THEN 'medium' WHEN NOT a THEN 'high' WHEN c OR b THEN 'low' ELSE 'high' END AS confidence,
 (CASE WHEN a IS NULL THEN 'possibly_valid' WHEN NOT a THEN 'smtp_invalid' WHEN c THEN 'catch_all' ELSE 'valid' END) IN ({_in(validate.FALLBACK_REASONS)}) AS fallback
 FROM (SELECT id, {_ACCEPTED} AS a, id % 5 = 0 AS c, id % 7 = 0 AS b FROM zen_contacts)""",
)
def probe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of a probe's answers, given out by the row's number."""
    i = F.col("id")
    accepted = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    z = table(spark, sf_dir, "zen_contacts").select("id", validate.probe_outcome(accepted, i % 5 == 0, i % 7 == 0).alias("p")).select("id", "p.*")
    return z.withColumn("fallback", validate.needs_fallback(F.col("reason")))


_PV = _case([(f"id % 6 = {i}", str(validate.PROVIDER_STATUS.get(w, (False,))[0]).lower()) for i, w in enumerate(_WORDS)], "false")
_PR = _case([(f"id % 6 = {i}", f"'{validate.PROVIDER_STATUS[w][1] if w in validate.PROVIDER_STATUS else 'smtp_invalid'}'") for i, w in enumerate(_WORDS)], "''")


@R.add(
    "provider_merges",
    f"""SELECT id, CASE WHEN d THEN pv ELSE true END AS valid, CASE WHEN d THEN pr ELSE 'not_probed' END AS reason, 'unknown' AS confidence, false AS is_big_provider
 FROM (SELECT *, pv OR pr IN ('invalid_format', 'domain_not_found', 'disposable_email') AS d FROM (SELECT id, {_PV} AS pv, {_PR} AS pr FROM zen_contacts))""",
)
def provider_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's status, of every kind by the row's number, over a local result that is still open."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.pmod("id", F.lit(6)) + 1).cast("int"))
    local = F.struct(F.lit(True).alias("valid"), F.lit("not_probed").alias("reason"), F.lit("unknown").alias("confidence"), F.lit(False).alias("is_big_provider"))
    return table(spark, sf_dir, "zen_contacts").select("id", validate.merge_results(local, validate.provider_result(word)).alias("m")).select("id", "m.*")


@R.add("catch_all_domains", "SELECT id, (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) >= 2 AS catch_all FROM zen_contacts")
def catch_all_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return table(spark, sf_dir, "zen_contacts").select("id", validate.catch_all(F.array(i % 2 == 0, i % 3 == 0)).alias("catch_all"))


@R.add(
    "validated_texts",
    """SELECT id, array_to_string(list_transform(list_filter(emails, lambda e, i: list_position(emails, e) = i), lambda e: e), '; ') AS addresses, len(list_distinct(emails)) AS n
 FROM (SELECT id, list_filter(list_transform(coalesce(emails, []), lambda e: lower(trim(e))), lambda e: e <> '') AS emails FROM zen_contacts)""",
)
def validated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation text of a row, its bracketed parts taken off again, and the number of results."""
    results = validate.validate_batch(F.coalesce("emails", F.array().cast("array<string>")))
    z = table(spark, sf_dir, "zen_contacts").select("id", validate.format_validated(results).alias("t"), F.size(results).cast("long").alias("n"))
    return z.select("id", F.regexp_replace("t", r" \(reason:[^()]*, conf:[^()]*, big:(?:True|False)\)", "").alias("addresses"), "n")


# ---------------------------------------------------------------- lines, files, endpoints
_LINES = """(SELECT listing_id, CASE listing_id % 6 WHEN 0 THEN h || ':' || p WHEN 1 THEN h || ':' || p || ':u' || listing_id || ':w' WHEN 2 THEN 'socks5://u:w@' || h || ':' || p WHEN 3 THEN 'u:w@' || h || ':' || p WHEN 4 THEN '# ' || h ELSE h || ':99999' END AS line,
 h, p, listing_id % 6 AS k FROM (SELECT listing_id, '10.' || (listing_id % 300) || '.0.' || (listing_id % 7) AS h, (listing_id * 37) % 60000 + 1 AS p FROM sample_input))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("listing_id")
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    h = text("10.", (i % 300).cast("string"), ".0.", (i % 7).cast("string"))
    p = ((i * 37) % 60000 + 1).cast("string")
    line = (
        F.when(i % 6 == 0, text(h, ":", p)).when(i % 6 == 1, text(h, ":", p, ":u", i.cast("string"), ":w")).when(i % 6 == 2, text("socks5://u:w@", h, ":", p))
        .when(i % 6 == 3, text("u:w@", h, ":", p)).when(i % 6 == 4, text("# ", h)).otherwise(text(h, ":99999"))
    )
    return table(spark, sf_dir, "sample_input").select("listing_id", line.alias("line"))


@R.add(
    "endpoints",
    f"""SELECT line, h || ':' || p AS server, CASE k WHEN 2 THEN 'socks5' ELSE 'http' END AS protocol, CASE k WHEN 1 THEN 'u' || listing_id WHEN 2 THEN 'u' WHEN 3 THEN 'u' END AS username, CASE WHEN k IN (1, 2, 3) THEN 'w' END AS password
 FROM {_LINES} WHERE k < 4""",
)
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_endpoints(_lines(spark, sf_dir).select("line").filter(~F.col("line").startswith("#")))


@R.add("valid_endpoints", f"SELECT listing_id, k < 4 AND listing_id % 300 <= 255 AS valid FROM {_LINES} WHERE k IN (0, 5)")
def valid_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).filter((F.col("listing_id") % 6).isin(0, 5))
    return lines.select("listing_id", readers.valid_ip_port(F.col("line")).alias("valid"))


@R.add(
    "usable_endpoints",
    f"SELECT DISTINCT h || ':' || p AS server FROM {_LINES} WHERE k < 4 EXCEPT SELECT h || ':' || p FROM {_LINES} WHERE k = 1",
)
def usable_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints without those that failed (here: those with a name of their own)."""
    all_of = readers.parse_endpoints(_lines(spark, sf_dir).select("line").filter(~F.col("line").startswith("#")))
    return merging.still_usable(all_of.select("server").distinct(), all_of.filter(F.col("username").rlike(r"^u\d")).select("server"), "server")


@R.add(
    "endpoint_turns",
    """WITH s AS (SELECT server_id, row_number() OVER (ORDER BY server_id) - 1 AS slot, count(*) OVER () AS n FROM zen_servers)
 SELECT id, turn, server_id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS turn FROM zen_jobs) j JOIN s ON s.slot = j.turn % s.n""",
)
def endpoint_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.round_robin(table(spark, sf_dir, "zen_jobs").select("id"), ["id"], table(spark, sf_dir, "zen_servers"), "server_id").select("id", "turn", "server_id")


@R.add("distinct_lines", "SELECT DISTINCT trim(raw_line) AS line FROM listing_lines WHERE trim(raw_line) <> '' AND NOT starts_with(trim(raw_line), '#')")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.trim("raw_line").alias("line")
    return table(spark, sf_dir, "listing_lines").select(line).filter((F.col("line") != "") & ~F.col("line").startswith("#")).distinct()


@R.add(
    "unprocessed_files",
    "SELECT DISTINCT batch_file AS name FROM sample_input WHERE batch_file IS NOT NULL AND regexp_replace(batch_file, '\\.csv$', '') NOT IN (SELECT regexp_replace(batch_file, '\\.csv$', '') FROM listing_lines WHERE batch_file IS NOT NULL)",
)
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "sample_input").filter("batch_file IS NOT NULL").select(F.col("batch_file").alias("name")).distinct()
    done = table(spark, sf_dir, "listing_lines").filter("batch_file IS NOT NULL").select(F.concat(F.regexp_replace("batch_file", r"\.csv$", ""), F.lit("_processed.csv")).alias("name"))
    return readers.unprocessed(files, done)


@R.add("url_count", "SELECT count(*) AS n FROM sample_input WHERE trim(url) <> ''")
def url_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(readers.count_with_url(table(spark, sf_dir, "sample_input")),)], "n long")


@R.add("first_rows", "SELECT listing_id, url FROM sample_input WHERE trim(url) <> '' ORDER BY listing_id LIMIT 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial limit: the first rows with an address in a stable order."""
    return table(spark, sf_dir, "sample_input").filter(F.trim("url") != "").select("listing_id", "url").orderBy("listing_id").limit(100)


# ---------------------------------------------------------------- tables
@R.add(
    "registered_server",
    f"""SELECT server_id, CASE WHEN h THEN 'online' ELSE status END AS status, CASE WHEN h THEN server_id || '_' || strftime({NOW}, '%Y%m%d_%H%M%S') ELSE session_id END AS session_id, CASE WHEN h THEN 0 ELSE total_processed END AS total_processed,
 CASE WHEN h THEN {NOW} ELSE started_at END AS started_at FROM (SELECT *, server_id = (SELECT min(server_id) FROM zen_servers) AS h FROM zen_servers)""",
)
def registered_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = table(spark, sf_dir, "zen_servers")
    return dashboard.register(servers, servers.agg(F.min("server_id")).first()[0]).select("server_id", "status", "session_id", "total_processed", "started_at")


@R.add("unregistered_server", "SELECT server_id, CASE WHEN h THEN 'offline' ELSE status END AS status, CASE WHEN NOT h THEN current_task END AS current_task FROM (SELECT *, server_id = (SELECT min(server_id) FROM zen_servers) AS h FROM zen_servers)")
def unregistered_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = table(spark, sf_dir, "zen_servers")
    return dashboard.unregister(servers, servers.agg(F.min("server_id")).first()[0]).select("server_id", "status", "current_task")


@R.add("session_ids", "SELECT server_id, server_id || '_' || strftime(started_at, '%Y%m%d_%H%M%S') AS session FROM zen_servers WHERE started_at IS NOT NULL")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zen_servers").filter("started_at IS NOT NULL").select("server_id", common.session_id(F.col("server_id"), F.col("started_at")).alias("session"))


@R.add(
    "fetch_health",
    """SELECT count(*) AS probes, count(*) FILTER (WHERE g) AS ok, count(*) FILTER (WHERE NOT g) AS bad, round(coalesce(avg(load_seconds) FILTER (WHERE g), 0), 3) AS avg_seconds,
 CAST(round(CAST(count(*) FILTER (WHERE g) AS DECIMAL(28,10)) * 100 / nullif(count(*), 0), 1) AS DOUBLE) AS ok_percent FROM (SELECT *, coalesce(status_code = 200 AND fetch_error IS NULL, false) AS g FROM pages)""",
)
def fetch_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.health_summary(table(spark, sf_dir, "pages"), (F.col("status_code") == 200) & F.col("fetch_error").isNull(), "load_seconds")


_J = "(SELECT id, TRY_CAST(data AS JSON) AS j FROM results)"
_T = lambda k: f"coalesce(trim(j->>'$.{k}'), '')"
_COUNTRY = "coalesce(upper(substr(nullif(trim(j->>'$.complete_address.country'), ''), 1, 2)), 'XX')"
_NAMES = "CASE cc " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in merging.COUNTRY_NAMES.items()) + " ELSE '' END"


@R.add(
    "prepared_contacts",
    f"""SELECT source_id, source_link, CAST(CAST('0x' || substr(md5(source_link), 1, 8) AS BIGINT) % 32 AS INTEGER) AS partition_key, cc AS country_code, {_NAMES} AS country_name, * EXCLUDE (source_id, source_link, cc) FROM (
 SELECT id AS source_id, trim(j->>'$.link') AS source_link, CASE WHEN regexp_full_match({_COUNTRY}, '[A-Z]{{2}}') THEN {_COUNTRY} ELSE 'XX' END AS cc, {_T('title')} AS business_name, {_T('category')} AS business_category, trim(j->>'$.web_site') AS business_website,
 {_T('complete_address.city')} AS city, {_T('complete_address.state')} AS state, {_T('complete_address.street')} AS street, {_T('complete_address.postal_code')} AS postal_code, {_T('address')} AS address, {_T('timezone')} AS timezone,
 {_T('phone')} AS gmaps_phone, CAST(j->>'$.review_rating' AS DOUBLE) AS gmaps_rating, CAST(j->>'$.review_count' AS INTEGER) AS gmaps_review_count, {_T('cid')} AS gmaps_cid, {_T('data_id')} AS gmaps_data_id, {_T('price_range')} AS gmaps_price_range,
 {_T('claimed')} AS gmaps_status, {_T('domain')} AS gmaps_domain, CAST(j->>'$.latitude' AS DOUBLE) AS latitude, coalesce(nullif(CAST(j->>'$.longtitude' AS DOUBLE), 0), CAST(j->>'$.longitude' AS DOUBLE)) AS longitude,
 0 AS emails_count, 0 AS phones_count, 'unknown' AS scrape_status, '' AS scrape_error, 0.0::DOUBLE AS scrape_time_seconds, 1 AS scrape_count, 'unknown' AS last_scrape_server, trim(j->>'$.web_site') AS scrape_final_url
 FROM {_J} WHERE j IS NOT NULL AND trim(coalesce(j->>'$.link', '')) <> '' AND trim(coalesce(j->>'$.web_site', '')) <> '')""",
)
def prepared_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the contact table before anything was fetched."""
    p = merging.prepared_contacts(readers.parse_results(table(spark, sf_dir, "results")))
    return p.select(
        "source_id", "source_link", "partition_key", "country_code", "country_name", "business_name", "business_category", "business_website", "city", "state", "street", "postal_code", "address", "timezone",
        "gmaps_phone", "gmaps_rating", "gmaps_review_count", "gmaps_cid", "gmaps_data_id", "gmaps_price_range", "gmaps_status", "gmaps_domain", "latitude", "longitude", "emails_count", "phones_count",
        "scrape_status", "scrape_error", "scrape_time_seconds", "scrape_count", "last_scrape_server", "scrape_final_url",
    )


_LIST = "array_to_string(coalesce({0}, []), '; ')"


@R.add(
    "output_file",
    f"""SELECT CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS "No", coalesce(business_name, '') AS name, coalesce(business_website, '') AS url, {_LIST.format('emails')} AS emails, {_LIST.format('phones')} AS phones, {_LIST.format('whatsapp')} AS whatsapp,
 coalesce(len(emails), 0)::INTEGER AS emails_found, coalesce(len(phones), 0)::INTEGER AS phones_found, coalesce(scrape_status, '') AS scraping_status, coalesce(scrape_error, '') AS scraping_error, '' AS tiktok, 0 AS validated_whatsapp_count FROM zen_contacts""",
)
def output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output row builder over the contact table; columns that hold what fetching gave."""
    z = table(spark, sf_dir, "zen_contacts").select(
        "id", F.col("business_name").alias("name"), F.col("business_website").alias("url"), F.col("scrape_status").alias("scraping_status"), F.col("scrape_error").alias("scraping_error"), *merging.ARRAYS
    )
    n = merging.row_numbers(z, ["id"])
    out = postprocess.output_rows(n, F.col("rn"))
    return out.select("No", "name", "url", "emails", "phones", "whatsapp", "emails_found", "phones_found", "scraping_status", "scraping_error", "tiktok", "validated_whatsapp_count")


_ITEMS = "len(list_filter(list_transform(string_split({0}, ';'), lambda x: trim(x)), lambda x: x <> ''))"
_Z = f"(SELECT {_LIST.format('emails')} AS em, {_LIST.format('phones')} AS ph, {_LIST.format('whatsapp')} AS wa FROM zen_contacts)"


@R.add(
    "wide_report",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE e + p + w > 0) AS rows_with_contacts, 0::BIGINT AS rows_with_valid_emails, sum(least(e, 10))::BIGINT AS total_emails, sum(least(p, 10))::BIGINT AS total_phones,
 sum(least(w, 10))::BIGINT AS total_whatsapp, 0::BIGINT AS total_validated_emails, round(count(*) FILTER (WHERE e + p + w > 0) * 100.0::DOUBLE / count(*), 2) AS contact_rate
 FROM (SELECT {_ITEMS.format('em')} AS e, {_ITEMS.format('ph')} AS p, {_ITEMS.format('wa')} AS w FROM {_Z})""",
)
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.wide_report(_processed(spark, sf_dir))


@R.add(
    "insert_defaults",
    "SELECT id, CASE WHEN emails_count > 0 THEN true ELSE false END AS has_email, round(coalesce(processed_rows * 100.0::DOUBLE / nullif(total_rows, 0), 0), 2) AS percent FROM zen_contacts JOIN (SELECT max(processed_rows) AS processed_rows, max(total_rows) AS total_rows FROM zen_jobs) ON true",
)
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated columns: flags by counts, progress by a guarded ratio."""
    top = table(spark, sf_dir, "zen_jobs").agg(F.max("processed_rows").alias("done"), F.max("total_rows").alias("all")).first()
    percent = F.round(common.safe_div(F.lit(top["done"]) * F.lit(100.0), F.lit(top["all"])), 2)
    return table(spark, sf_dir, "zen_contacts").select("id", F.coalesce(F.col("emails_count") > 0, F.lit(False)).alias("has_email"), percent.alias("percent"))
