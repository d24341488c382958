"""Classification of fetch outcomes: wait pages, certificate errors, need of another route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
STRONG_WAIT = (
    "just a moment", "verify you are human", "checking your browser", "please wait while", "attention required", "cf-please-wait", "redirecting…",
    "redirecting...", "ddos protection by", "browser verification", "security check", "loading...", "challenge-platform",
)
WEAK_WAIT = ("cf-challenge", "data-cf", "turnstile", "captcha", "recaptcha", "hcaptcha", "ray id", "cf-ray", "cdn-cgi", "data-cf-beacon")
WAIT_CONTENT = ("cloudflare", "cf-ray", "cf_chl_", "challenge-platform", "turnstile", "checking your browser", "__cf_bm", "cf-browser-verification", "cdn-cgi/challenge")
ANTIBOT_CONTENT = (
    "recaptcha", "hcaptcha", "distil_r_captcha", "perimeterx", "px-captcha", "you have been blocked", "access denied", "rate limit exceeded", "datadome",
)
SSL_WORDS = ("ssl_error", "sec_error", "certificate", "issuer", "cert_", "mozilla_pkix", "untrusted", "invalid", "expired", "revoked", "chain")
#: Ordered classes; the first pattern that matches decides.
SSL_CLASSES = (
    ("hostname_mismatch", r"hostname.*mismatch|certificate verify failed.*hostname|doesn't match|SSL_ERROR_BAD_CERT_DOMAIN|SSL_ERROR_UNKNOWN_ISSUER"),
    ("certificate_expired", r"certificate.*expired|notAfter|SEC_ERROR_EXPIRED_CERTIFICATE"),
    ("self_signed_certificate", r"self.signed|certificate verify failed.*self|SEC_ERROR_SELF_SIGNED_CERT"),
    (
        "untrusted_root",
        r"CERTIFICATE_VERIFY_FAILED|certificate verify failed|unable to get local issuer certificate|untrusted|SEC_ERROR_UNKNOWN_ISSUER|SEC_ERROR_UNTRUSTED_ISSUER|MOZILLA_PKIX_ERROR_UNKNOWN_ISSUER",
    ),
    ("chain_incomplete", r"chain.*incomplete|missing.*chain|intermediate.*certificate|SEC_ERROR_INCOMPLETE_CERT_CHAIN"),
    ("certificate_revoked", r"revoked|SEC_ERROR_REVOKED_CERTIFICATE"),
)
#: Recovery by class: skip, other route, retries, extra seconds.
RECOVERY = {
    "hostname_mismatch": (False, True, 2, 10), "self_signed_certificate": (False, True, 1, 5), "untrusted_root": (False, True, 2, 10),
    "certificate_expired": (True, False, 0, 0), "certificate_revoked": (True, False, 0, 0),
}
RECOVERY_ELSE = (False, True, 1, 5)


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _count(text: Column, words) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))


def looks_like_challenge(html: Column) -> Column:
    """The page is a wait page: empty, or small with telling phrases."""
    low, n = F.lower(html), F.length(html)
    return (
        F.when(html.isNull() | (n == 0), True)
        .when(n > 10000, False)
        .when(_any(low, STRONG_WAIT), True)
        .when((_count(low, WEAK_WAIT) >= 3) & (n < 5000), True)
        .otherwise(low.contains("cloudflare") & (n < 2000))
    )


def wait_page(status: Column, server: Column, has_cf_header: Column, content_type: Column, body: Column) -> Column:
    """Wait page from headers, status and the first 4 KB."""
    cf = F.coalesce(F.lower(server).contains("cloudflare"), F.lit(False)) | F.coalesce(has_cf_header, F.lit(False))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    snippet = F.substring(body, 1, 4096)
    low = F.lower(snippet)
    return (
        F.when(cf & status.isin(403, 429, 503), True)
        .when(~kind.contains("text/html") & ~kind.contains("application/xhtml+xml"), False)
        .when(looks_like_challenge(snippet), True)
        .otherwise(cf & (F.length(snippet) < 2048) & (~low.contains("<body") | low.contains('content="0;url=')))
    )


def proxy_need(error: Column, status: Column, load_seconds: Column, html: Column, flagged: Column) -> Column:
    """Struct (use_proxy, timeout, reason): the first category that fits."""
    e, low, n = F.lower(F.coalesce(error, F.lit(""))), F.lower(F.coalesce(html, F.lit(""))), F.length(F.coalesce(html, F.lit("")))
    took = F.coalesce(load_seconds, F.lit(0.0))
    ladder = [
        (e.contains("cloudflare wait page") & e.contains("persisted"), 75, "CF_wait_exceeded"),
        (e.contains("cloudflare challenge"), 75, "CF_challenge"),
        (e.contains("timeout") & ~e.contains("cloudflare") & (took >= 50), 120, "long_timeout"),
        (e.contains("timeout") & ~e.contains("cloudflare"), 90, "quick_timeout"),
        (e.contains("dynamic_fetch_timeout"), 60, "dynamic_timeout"),
        (status == 403, 30, "forbidden_403"),
        (status == 429, 30, "rate_limited_429"),
        (status == 503, 45, "service_unavailable_503"),
        ((status == 408) & (took >= 60), 60, "timeout_408_long"),
        (status == 408, 30, "timeout_408_quick"),
        (_any(low, WAIT_CONTENT), 75, "CF_detected_content"),
        (_any(low, ANTIBOT_CONTENT), 60, "antibot_detected"),
        ((n > 0) & (n < 200), 30, "small_html"),
        (F.coalesce(flagged, F.lit(False)), 75, "explicit_proxy_flag"),
    ]
    timeout, reason = F.lit(0), F.lit("no_proxy_needed")
    for cond, seconds, name in reversed(ladder):
        hit = F.coalesce(cond, F.lit(False))
        timeout, reason = F.when(hit, seconds).otherwise(timeout), F.when(hit, name).otherwise(reason)
    return F.struct((reason != "no_proxy_needed").alias("use_proxy"), timeout.alias("timeout"), reason.alias("reason"))


def retry_plan(reason: Column) -> Column:
    """Struct (budget class, retries, retry seconds) by reason."""
    wait = reason.isin("CF_wait_exceeded", "CF_challenge", "CF_detected_content")
    dead = reason.isin("connection_refused", "dns_error", "invalid_url")
    return F.struct(
        F.when(wait | (reason == "explicit_proxy_flag"), "challenge").when(dead, "dead_site").otherwise("normal").alias("budget"),
        F.when(wait | (reason == "antibot_detected"), 2).when(dead, 1).otherwise(3).alias("retries"),
        F.when(wait, 60).when(reason == "antibot_detected", 50).otherwise(25).alias("retry_seconds"),
    )


def is_ssl_error(error: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(
        low.rlike("|".join(SSL_WORDS)) & (low.contains("error") | error.contains("SEC_") | error.contains("SSL_")), F.lit(False)
    )


def ssl_class(error: Column) -> Column:
    c = F.lit("unknown_ssl_error")
    for name, pattern in reversed(SSL_CLASSES):
        c = F.when(error.rlike(f"(?i){pattern}"), name).otherwise(c)
    return F.when(is_ssl_error(error), c).otherwise("not_ssl_error")


def ssl_details(error: Column) -> Column:
    """Struct (is_ssl_error, error_type, code, expected_host, skip, other_route, retries, extra_seconds)."""
    kind = ssl_class(error)
    skip, route, retries, extra = (F.lit(x) for x in RECOVERY_ELSE)
    for name, (s, r, n, t) in RECOVERY.items():
        hit = kind == name
        skip, route = F.when(hit, s).otherwise(skip), F.when(hit, r).otherwise(route)
        retries, extra = F.when(hit, n).otherwise(retries), F.when(hit, t).otherwise(extra)
    return F.struct(
        (kind != "not_ssl_error").alias("is_ssl_error"),
        kind.alias("error_type"),
        F.regexp_extract(error, r"(SEC_ERROR_\w+|SSL_ERROR_\w+)", 1).alias("code"),
        F.regexp_extract(error, r"(?i)doesn't match (?:either of )?'([^']+)'", 1).alias("expected_host"),
        skip.alias("skip"), route.alias("other_route"), retries.alias("retries"), extra.alias("extra_seconds"),
    )


def browser_error_type(error: Column) -> Column:
    code = F.regexp_extract(error, r"(SEC_ERROR_\w+|SSL_ERROR_\w+)", 1)
    return F.when(code != "", F.concat(F.lit("ssl_certificate ("), code, F.lit(")")))


def scrape_status(url: Column, social: Column, error: Column, contacts: Column) -> Column:
    """success / no_contacts_found / failed / skipped_social / error; contacts found on any page outweigh a page that failed."""
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "error")
        .when(social, "skipped_social")
        .when(contacts > 0, "success")
        .when(F.coalesce(error, F.lit("")) != "", "failed")
        .otherwise("no_contacts_found")
    )


#: Words of contact pages in address, title and headings, by language (fixed values).
CONTACT_WORDS = (
    "contact", "about", "support", "help", "info", "team", "company", "reach", "connect", "touch", "call", "phone", "email", "message",
    "kontak", "hubungi", "tentang", "layanan", "bantuan", "dukungan", "informasi", "perusahaan", "tim", "kantor", "alamat", "telepon",
    "contacto", "acerca", "sobre", "soporte", "ayuda", "servicio", "empresa", "equipo", "oficina", "direccion", "telefono", "correo",
    "propos", "aide", "service", "entreprise", "equipe", "bureau", "adresse", "telephone", "courriel",
    "kontakt", "uber", "hilfe", "unternehmen", "buro", "telefon", "kundendienst",
    "contato", "suporte", "ajuda", "atendimento", "escritorio", "endereco", "telefone",
    "contatto", "riguardo", "supporto", "aiuto", "servizio", "azienda", "ufficio", "indirizzo", "assistenza",
    "over", "ondersteuning", "hulp", "bedrijf", "kantoor", "adres", "telefoon", "klantenservice",
)
#: Words of contact forms, by language (fixed values).
FORM_WORDS = (
    "email", "message", "name", "phone", "subject", "inquiry", "comment", "feedback", "question", "request", "contact", "address", "company",
    "pesan", "nama", "telepon", "subjek", "pertanyaan", "komentar", "masukan", "saran", "permintaan", "kontak", "alamat", "perusahaan",
    "correo", "mensaje", "nombre", "telefono", "asunto", "consulta", "comentario", "pregunta", "solicitud", "contacto", "direccion", "empresa",
    "courriel", "nom", "telephone", "sujet", "demande", "commentaire", "requete", "adresse", "entreprise",
    "nachricht", "telefon", "betreff", "anfrage", "kommentar", "frage", "antrag", "kontakt", "unternehmen",
    "mensagem", "nome", "telefone", "assunto", "pergunta", "solicitacao", "contato", "endereco",
    "submit", "send", "enviar", "kirim", "envoyer", "senden", "inviare",
)


def is_contact_page(html: Column, url: Column, title: Column, headings: Column, forms: Column) -> Column:
    """A word of contacts stands in the address, the title or a heading, or a form asks for what such forms ask for. Without html: false."""
    words, asks = "|".join(CONTACT_WORDS), "|".join(FORM_WORDS)
    says = lambda c, w: F.coalesce(F.lower(c).rlike(w), F.lit(False))
    any_of = lambda a, w: F.coalesce(F.exists(a, lambda x: F.lower(x).rlike(w)), F.lit(False))
    return (F.length(F.coalesce(html, F.lit(""))) > 0) & (says(url, words) | says(title, words) | any_of(headings, words) | any_of(forms, asks))


def is_html_like(text: Column) -> Column:
    return F.coalesce(text.rlike(r"<[^>]+>") & ~text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(False))
