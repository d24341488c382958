import pytest
from pyspark.sql import functions as F

from contactweave.functions import classify, common, contacts, html_contacts, phones, urls, validate
from contactweave.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://example.com/?utm_source=google&utm_medium=cpc&utm_campaign=test&page=1", "https://example.com/?page=1"),
        ("https://example.com/page?fbclid=IwAR123&id=5&gclid=ABC123", "https://example.com/page?id=5"),
        ("https://example.com/page?utm_source=facebook&utm_medium=feed&id=123#section", "https://example.com/page?id=123"),
        ("  EXAMPLE.COM  ", "https://example.com"), ("//example.com", "https://example.com"), ("http://example.com", "https://example.com"),
        ("INVALID_URL_FORMAT", None), ("", None), (None, None),
        ("https://www.google.com/url?q=https://example.com/page&hl=en", "https://example.com/page"),
        ("https://a.example/?PHPSESSID=1&b=2&b=3&c=", "https://a.example/?b=2&c"),
        ("https://www.google.com/url?q=https%3A%2F%2Fexample.com%2Fp", "https://example.com/p"),
    ],
)
def test_clean_url(spark, raw, want):
    assert one(spark, urls.clean_url(F.lit(raw).cast("string"))) == want


def test_url_predicates(spark):
    assert one(spark, urls.is_google_redirect(F.lit("https://a.example/urls?faq=1")))
    assert not one(spark, urls.is_google_redirect(F.lit(None).cast("string")))
    assert one(spark, urls.is_social_url(F.lit("https://www.facebook.com/x"))) and not one(spark, urls.is_social_url(F.lit("https://netflix.com")))
    assert one(spark, urls.is_social_url(F.lit("https://netflix.com"), substring=True))
    assert one(spark, urls.is_internal_link(F.lit("https://a.example/x"), F.lit("https://a.example")))
    assert not one(spark, urls.is_internal_link(F.lit("mailto:a@b.example"), F.lit("https://a.example")))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("user@shop-one.comphone", "user@shop-one.com"), ("<Info@Shop.example.org>", "info@shop.example.org"), ("a@b.png", None), ("904-1978info@shop.org", "info@shop.org"),
        ("ushello@shop.org", "hello@shop.org"), ("x@gmail.comname.org", None), ("12345678@shop.org", None), ("", None), (None, None), ("team@net.company", "team@net.company"),
        ("info@hotel.berlin", "info@hotel.berlin"), ("x@bar.cloud", "x@bar.cloud"), ("me@shop.club", "me@shop.club"), ("a@foo.company", "a@foo.company"), ("a@foo.comphone", "a@foo.com"), ("jo@studio.design", None),
    ],
)
def test_normalize_email(spark, raw, want):
    assert one(spark, contacts.normalize_email(F.lit(raw).cast("string"))) == want


def test_email_rules(spark):
    ok = lambda x: one(spark, contacts.is_plausible_local(F.lit(x)))
    assert ok("info") and ok("jo.doe")
    assert not any(ok(x) for x in ("", "-a", "ca949-509-1050losangeles", "malta.malta.malta", "aaaab", "123456789", "myemailbox", "x" * 65))
    assert one(spark, contacts.is_placeholder_email(F.lit("noreply@shop.org"))) and not one(spark, contacts.is_placeholder_email(F.lit("jo@shop.org")))
    got = one(spark, contacts.drop_variants(F.array(F.lit("hypmalta@gmail.com"), F.lit("maltaemailhypmalta@gmail.com"), F.lit("jo@x.org"))))
    assert got == ["hypmalta@gmail.com", "jo@x.org"]
    assert one(spark, contacts.text_emails(F.lit("Write to jo [at] shop [dot] org or jo@shop.org"))) == ["jo@shop.org"]
    assert one(spark, contacts.emails_in(F.lit(None).cast("string"))) == []


def test_hex_and_links(spark):
    code = "2a" + "".join(f"{ord(c) ^ 0x2A:02x}" for c in "a@b.org")
    assert one(spark, contacts.hex_email(F.lit(code))) == "a@b.org" == html_contacts.decode_hex_email(code)
    assert one(spark, contacts.messenger_numbers(F.lit("x wa.me/35612345678 api.whatsapp.com/send?phone=+49555"))) == ["+35612345678", "+49555"]
    assert one(spark, contacts.social_handle(F.lit("see https://www.tiktok.com/@shop?x"), "tiktok")) == "shop"


def test_validation(spark):
    v = one(spark, validate.validate_email(F.lit("Jo@googlemail.com")))
    assert v["is_big_provider"] and v["reason"] == "placeholder_domain"
    assert one(spark, validate.validate_email(F.lit("jo@shop.org")))["reason"] == "not_probed"
    assert one(spark, validate.validate_email(F.lit(None).cast("string")))["reason"] == "invalid_format"
    assert one(spark, validate.probe_outcome(F.lit(None).cast("boolean"), F.lit(False), F.lit(False)))["reason"] == "possibly_valid"
    assert one(spark, validate.provider_result(F.lit("disposable")))["reason"] == "disposable_email"
    m = one(spark, validate.format_validated(validate.validate_batch(F.array(F.lit("jo@shop.org"), F.lit("JO@shop.org")))))
    assert m == "jo@shop.org (reason:not_probed, conf:unknown, big:False)"
    assert one(spark, validate.catch_all(F.array(F.lit(True), F.lit(True))))


def test_classes(spark):
    ssl = lambda e: one(spark, classify.ssl_class(F.lit(e)))
    assert ssl("SSL_ERROR_BAD_CERT_DOMAIN") == "hostname_mismatch" and ssl("SEC_ERROR_EXPIRED_CERTIFICATE") == "certificate_expired"
    assert ssl("error: self-signed certificate") == "self_signed_certificate" and ssl("timeout") == "not_ssl_error"
    d = one(spark, classify.ssl_details(F.lit("SSL error: hostname 'a' doesn't match 'b.example'")))
    assert d["expected_host"] == "b.example" and d["other_route"] and not d["skip"]
    assert one(spark, classify.looks_like_challenge(F.lit("<html>Just a moment</html>"))) and not one(spark, classify.looks_like_challenge(F.lit("x" * 10001)))
    assert one(spark, classify.proxy_need(F.lit("Timeout"), F.lit(0), F.lit(60.0), F.lit(None).cast("string"), F.lit(False)))["reason"] == "long_timeout"
    assert one(spark, classify.retry_plan(F.lit("antibot_detected")))["retries"] == 2
    assert one(spark, classify.wait_page(F.lit(403), F.lit("cloudflare"), F.lit(False), F.lit("text/html"), F.lit("x")))
    assert one(spark, classify.browser_error_type(F.lit("x SEC_ERROR_UNKNOWN_ISSUER y"))) == "ssl_certificate (SEC_ERROR_UNKNOWN_ISSUER)"


@pytest.mark.parametrize(
    ("raw", "region", "want"),
    [("+49 151 2345678", None, ("+491512345678", "DE", "mobile", "valid")), ("+356 21234567", None, ("+35621234567", "MT", "fixed_line", "valid")), ("0049 30 123456", None, ("+4930123456", "DE", "fixed_line", "valid")), ("030 123456", "DE", ("+4930123456", "DE", "fixed_line", "valid")), ("12345", None, ("12345", "", "unknown", "no_country")), ("+999 1234567", None, ("+9991234567", "", "unknown", "unknown_region")), ("+356 12", None, ("+35612", "MT", "unknown", "invalid_format")), ("", None, ("", "", "unknown", "empty_number"))],
)
def test_phone(raw, region, want):
    assert phones.parse(raw, region) == want


def test_whatsapp():
    assert phones.check_whatsapp("+4915123456789")[0] and phones.check_whatsapp("+493012345678")[4] == "not_mobile" and phones.check_whatsapp(None)[4] == "empty_number"


PAGE = """<html><head><title>Contact us</title><script type="application/ld+json">{"@type":"LocalBusiness","email":"LD@shop.org","contactPoint":[{"telephone":"+356 2123 4567"}],"sameAs":["https://facebook.com/shop"]}</script></head>
<body><header><a href="mailto:Head@shop.org?subject=x">mail</a></header><main>jo (at) shop.org <a href="/contact">Kontakt</a><a href="https://else.example/contact">x</a><a href="/about">About</a>
<a href="tel:+35621234567">call</a><a href="https://wa.me/35699123456">wa</a></main><footer>foot@shop.org <a href="https://www.instagram.com/shop">i</a></footer><script>var config = {"email": "js@shop.org"};</script></body></html>"""


def test_page_contacts():
    got = html_contacts.contacts(PAGE)
    mails = [v for f, v, *_ in got if f == "email"]
    assert mails == ["head@shop.org", "foot@shop.org", "ld@shop.org"]
    assert {p for f, v, p, *_ in got if f == "social"} == {"facebook", "instagram"}
    assert [v for f, v, *_ in got if f == "whatsapp"] == ["+35699123456"]
    assert html_contacts.contact_links(PAGE, "https://shop.org/x") == ["https://shop.org/contact", "https://shop.org/about"]
    assert html_contacts.contacts(None) == [] and html_contacts.contacts("<a href=") == []
    assert "jo (at) shop.org" in html_contacts.page_text(PAGE)


def test_page_parts_and_structured_data():
    page = """<div id="header"><a href="mailto:top@shop.org">m</a></div><nav><a href="tel:+35621234567">t</a></nav><p>mid@shop.org</p><div class="x site-footer">end@shop.org</div>
<script type="application/ld+json">{"@type": "LocalBusiness", "email": ["a@firm.org", "b@firm.org"], "telephone": ["+356 2123 4567", 5], "contactPoint": [{"email": "c@firm.org"}]}</script>
<script>var socialLinks = {"facebookPage": "https://facebook.com/firm", "deep": [{"my_tiktok": "https://tiktok.com/@firm"}]};</script><script>x = "api.whatsapp.com/send?phone=35699111222"</script>
<a href="https://fb.me/p" aria-label="facebook">f</a>"""
    got = html_contacts.contacts(page)
    assert [(v, p) for f, v, _x, p, _o in got if f == "email"] == [("top@shop.org", "header"), ("end@shop.org", "footer"), ("a@firm.org", "structured"), ("b@firm.org", "structured"), ("c@firm.org", "structured"), ("mid@shop.org", "page")]
    assert ("+356 2123 4567", "structured") in [(v, p) for f, v, _x, p, _o in got if f == "phone"] and ("+35621234567", "header") in [(v, p) for f, v, _x, p, _o in got if f == "phone"]
    assert {(x, v) for f, v, x, _p, _o in got if f == "social"} == {("facebook", "https://facebook.com/firm"), ("tiktok", "https://tiktok.com/@firm")}
    assert [v for f, v, *_ in got if f == "whatsapp"] == ["+35699111222"]
    links = '<a href="/x/contactus.html">a</a><a href="/team">Our TEAM</a><a href="/x/contactus.html">again</a><a href="//else.example/contact">e</a><a href="tel:1">contact</a><a href="/p">Prices</a>'
    assert html_contacts.contact_links(links, "https://shop.org/q") == ["https://shop.org/x/contactus.html", "https://shop.org/team"]


def test_contact_page(spark):
    rows = [("<h2>Unser Team</h2>", "https://s.org/x"), ("<form><input name='your-message'></form>", "https://s.org/x"), ("<p>Bread</p>", "https://s.org/kontakt"), ("<p>Bread</p>", "https://s.org/x"), ("", "https://s.org/contact"), (None, None)]
    df = spark.createDataFrame(rows, "html string, url string").withColumn("f", html_contacts.html_facts("html"))
    got = [r[0] for r in df.select(classify.is_contact_page(F.col("html"), F.col("url"), F.col("f.title"), F.col("f.headings"), F.col("f.forms"))).collect()]
    assert got == [True, True, True, False, False, False]


def test_phone_arrays(spark):
    df = spark.createDataFrame([(["+49 151 2345678", "030 123456", "12", "+491512345678"], "DE"), (None, None), ([], "DE")], "a array<string>, r string")
    assert [r[0] for r in df.select(phones.normalize_phones("a", "r")).collect()] == [["+491512345678", "+4930123456", "12"], [], []]
    first = df.select(phones.check_whatsapps("a", "r")).first()[0]
    assert [(x["number"], x["valid"], x["reason"]) for x in first][:2] == [("+49 151 2345678", True, "valid"), ("030 123456", False, "not_mobile")]


def test_links_table_function(spark):
    spark.udtf.register("html_links", html_contacts.HtmlLinks)
    rows = spark.sql("SELECT * FROM html_links('<a href=\"/a\">x</a>', 'https://s.org')").collect()
    assert [tuple(r) for r in rows] == [("https://s.org/a", "x", "page")]


def test_common(spark):
    assert common.parse_size("3m") == 3 * 1024**2 and common.parse_size("1kb") == 1024
    with pytest.raises(ValueError):
        common.parse_size("x")
    assert one(spark, common.merge_arrays(F.array(F.lit("a"), F.lit(None)), F.array(F.lit("b"), F.lit("a"), F.lit("")))) == ["a", "b"]
    assert one(spark, common.safe_div(F.lit(1.0), F.lit(0))) == 0.0
    assert 0 <= one(spark, common.partition_key(F.lit("x"))) < 32
    assert common.chunk_rows(8, 50, 16) == 0 and common.chunk_rows(3, 50_000, 4) == 10_240 and common.chunk_rows(12, 9_000, 4) == 1000


def test_bytes():
    assert readers.decode_bytes("héllo".encode("utf-8"))[0] == "héllo"
    assert readers.decode_bytes("héllo".encode("cp1252")) == ("héllo", "cp1252")
    assert readers.decode_bytes('<meta charset="iso-8859-2">č'.encode("iso-8859-2"))[1] == "iso-8859-2"
    assert readers.decode_bytes("hi".encode("utf-16"))[0] == "hi" and readers.decode_bytes(None) == (None, None)
