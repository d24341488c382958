"""Contacts in fetched pages: one Arrow-batched pass parses each page once for every kind.

The result is an ordered array of structs; order says where a value was found (header, footer,
structured data, page), so that keep-first rules are array operations afterwards.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.functions.contacts import DEOBFUSCATION, EMAIL_PATTERN, MESSENGER_PATTERNS, PHONE_PATTERN, SOCIAL_PATTERNS

CONTACT_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("field", "value", "platform", "place")] + [T.StructField("ord", T.IntegerType())])
)
# ---------------------------------------------------------------- fixed values: links and pages about contacts
#: Paths of links that lead to a contact page.
CONTACT_PATHS = (
    "/contact", "/contact-us", "/contacts", "/contactus", "/contact_us", "/about", "/about-us", "/aboutus", "/about_us", "/company",
    "/support", "/customer-service", "/customer_support", "/help",
    "/kontak", "/hubungi", "/hubungi-kami", "/tentang", "/tentang-kami", "/layanan", "/bantuan", "/dukungan", "/informasi",
    "/info", "/information", "/reach-us", "/get-in-touch",
)
#: Words in the text of such links, by language.
CONTACT_TEXT = (
    "contact", "about", "support", "customer", "sales", "info", "help", "cs", "service", "team", "staff", "office", "reach", "connect", "get in touch", "talk to us", "call us",
    "email us", "message", "inquiry", "enquiry", "feedback", "company", "business", "corporate",
    "kontak", "hubungi", "tentang", "layanan", "bantuan", "dukungan", "informasi", "perusahaan", "tim", "kantor", "alamat", "telepon", "email", "formulir", "pertanyaan", "masukan", "saran",
    "acerca", "sobre", "soporte", "ayuda", "servicio", "empresa", "equipo", "oficina", "direccion", "telefono", "correo", "consulta",
    "propos", "aide", "entreprise", "equipe", "bureau", "adresse", "telephone", "courriel", "demande", "assistance",
    "uber", "hilfe", "unternehmen", "buro", "telefon", "formular", "anfrage", "kundendienst",
    "contato", "suporte", "ajuda", "atendimento", "escritorio", "endereco", "telefone", "servico",
    "contatto", "riguardo", "aiuto", "servizio", "azienda", "ufficio", "indirizzo", "modulo", "richiesta", "assistenza",
    "over", "ondersteuning", "hulp", "bedrijf", "adres", "telefoon", "vraag", "klantenservice",
    "phone", "tel", "fax", "address", "location", "map", "directions", "hours", "schedule", "appointment", "booking", "reservation", "quote", "estimate", "demo", "trial", "consultation", "meeting",
)
#: Variables of scripts whose object may hold profiles.
SCRIPT_NAMES = (
    "window.data", "window.__data", "window.__NEXT_DATA__", "window.config", "window.__INITIAL_STATE__", "window.__APP_STATE__", "window.INITIAL_STATE",
    "var socialLinks", "const social", "var contacts", "const config",
)
#: Tags, ids and classes of the parts of a page that are searched first.
PARTS = {
    "header": (("header", "nav"), ("header", "nav"), ("header", "site-header", "main-header", "navbar", "navigation")),
    "footer": (("footer",), ("footer",), ("footer", "site-footer", "main-footer")),
}

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template", "noscript"}


class _Page(HTMLParser):
    """Collects what the extractors read, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.parts: list[str] = []
        self.headings: list[str] = []
        self.forms: list[str] = []
        self.text: list[tuple[str, str]] = []
        self.links: list[list[str]] = []
        self.attrs: list[tuple[str, str, str]] = []
        self.metas: list[tuple[str, str]] = []
        self.items: list[tuple[str, str]] = []
        self.json_ld: list[str] = []
        self.scripts: list[str] = []
        self.title = ""
        self._script = ""
        self._open: list[str] | None = None
        self._prop: str | None = None

    def place(self) -> str:
        return "header" if "header" in self.parts else "footer" if "footer" in self.parts else "page"

    def description(self) -> str:
        return next((v for k, v in self.metas if k == "description"), "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.stack.append(tag)
            classes = set(a.get("class", "").split())
            self.parts.append(next((p for p, (tags, ids, names) in PARTS.items() if tag in tags or a.get("id") in ids or classes.intersection(names)), ""))
        if tag in ("h1", "h2", "h3"):
            self.headings.append("")
        if tag == "form":
            self.forms.append("")
        if tag in ("input", "textarea", "select") and "form" in self.stack:
            self.forms[-1] += " " + " ".join((a.get("name", ""), a.get("placeholder", ""), a.get("id", "")))
        if tag in ("i", "svg", "img", "span") and self._open is not None:
            self._open[3] += " " + " ".join((a.get("class", ""), a.get("alt", ""), a.get("title", "")))
        if tag == "a" and "href" in a:
            self._open = [a["href"].strip(), "", self.place(), " ".join((a.get("class", ""), a.get("title", ""), a.get("aria-label", "")))]
            self.links.append(self._open)
        if tag == "meta":
            self.metas.append(((a.get("property") or a.get("name") or "").lower(), a.get("content", "")))
        if tag == "link" and "href" in a:
            self.metas.append(("link:" + a.get("rel", "").lower(), a["href"]))
        prop = a.get("itemprop") or a.get("property")
        if prop and tag != "meta":
            self._prop = prop.lower()
            if a.get("content") or a.get("href"):
                self.items.append((self._prop, a.get("content") or a.get("href")))
        elif prop and a.get("itemprop"):
            self.items.append((prop.lower(), a.get("content", "")))
        for k, v in a.items():
            if v and (k in ("onclick", "data-cfemail") or "email" in k or "mail" in k):
                self.attrs.append((k, v, self.place()))
        if tag == "script":
            self._script = a.get("type", "").lower()

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack:
                self.parts.pop()
                if self.stack.pop() == tag:
                    break
        if tag == "a":
            self._open = None
        self._prop = None

    def handle_data(self, data):
        tag = self.stack[-1] if self.stack else ""
        if tag == "script":
            (self.json_ld if "ld+json" in self._script else self.scripts).append(data)
            return
        if tag in _HIDDEN:
            return
        if tag == "title":
            self.title += data
            return
        if self._open is not None:
            self._open[1] += data
        if self.headings and any(t in self.stack for t in ("h1", "h2", "h3")):
            self.headings[-1] += data
        if self.forms and "form" in self.stack:
            self.forms[-1] += data
        if self._prop:
            self.items.append((self._prop, data.strip()))
        if data.strip():
            self.text.append((data, self.place()))


def parse_page(html: str) -> _Page:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        pass  # what was read so far counts
    return page


def page_text(html: str | None) -> str:
    """Visible text, pieces joined by single spaces."""
    return " ".join(t.strip() for t, _ in parse_page(html).text) if html else ""


def decode_hex_email(code: str) -> str | None:
    """Address behind an XOR-coded hex string."""
    try:
        raw = bytes.fromhex(code)
    except ValueError:
        return None
    return "".join(chr(b ^ raw[0]) for b in raw[1:]) if len(raw) > 1 else None


def json_contacts(blob) -> list[tuple[str, str]]:
    """(field, value) of every contact key of a JSON-LD tree, however nested, values alone or in lists."""
    fields = {"email": "email", "telephone": "phone", "phone": "phone", "faxnumber": "phone", "sameas": "url", "url": "url"}
    out: list[tuple[str, str]] = []
    todo = deque([blob])
    while todo:
        node = todo.popleft()
        if isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            for k, v in node.items():
                field = fields.get(k.lower())
                if field:
                    out += [(field, x.removeprefix("mailto:")) for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]
                if isinstance(v, (dict, list)):
                    todo.append(v)
    return out


def json_profiles(blob) -> list[str]:
    """Values under keys that name a platform, however nested."""
    out: list[str] = []
    todo = deque([blob])
    while todo:
        node = todo.popleft()
        if isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            out += [v for k, v in node.items() if isinstance(v, str) and any(p in k.lower() for p in SOCIAL_PATTERNS)]
            todo.extend(v for v in node.values() if isinstance(v, (dict, list)))
    return out


def script_json(text: str) -> list:
    """JSON objects that follow the known variable names in a script."""
    out, decoder = [], json.JSONDecoder()
    for name in SCRIPT_NAMES:
        at = text.find(name)
        start = text.find("{", at) if at >= 0 else -1
        if start >= 0:
            try:
                out.append(decoder.raw_decode(text, start)[0])
            except ValueError:
                continue
    return out


def _deobfuscate(text: str) -> str:
    for pattern, sign in DEOBFUSCATION:
        text = re.sub(pattern, sign, text, flags=re.I)
    return text


def contacts(html: str | None) -> list[tuple[str, str, str | None, str, int]]:
    """(field, value, platform, place, ord): header, footer, structured data, then the page."""
    if not html:
        return []
    page = parse_page(html)
    found: dict[str, list[tuple[str, str, str | None]]] = {p: [] for p in ("header", "footer", "structured", "page")}
    mail = re.compile(EMAIL_PATTERN)

    def social(url: str, place: str) -> None:
        for platform, pattern in SOCIAL_PATTERNS.items():
            m = re.search(pattern, url)
            if m:
                found[place].append(("social", m[0] if m[0].startswith("http") else "https://" + m[0], platform))

    for href, _text, place, icon in page.links:
        low = href.lower()
        if low.startswith("mailto:"):
            for x in unquote(href[7:].split("?")[0]).split(","):
                if x.strip():
                    found[place].append(("email", x.strip().lower(), None))
        elif low.startswith("tel:"):
            found[place].append(("phone", unquote(href[4:]).strip(), None))
        elif "/cdn-cgi/l/email-protection#" in low:
            x = decode_hex_email(href.split("#", 1)[1])
            if x:
                found[place].append(("email", x.lower(), None))
        for p in MESSENGER_PATTERNS:
            found[place] += [("whatsapp", "+" + n.lstrip("+"), None) for n in re.findall(p, href)]
        social(href, place)
        if icon.strip() and href.startswith("http"):
            for platform in SOCIAL_PATTERNS:  # an icon or label names the platform of a shortened address
                if platform in icon.lower() and platform in low:
                    found[place].append(("social", href, platform))
    for k, v, place in page.attrs:
        x = decode_hex_email(v) if k == "data-cfemail" else None
        for e in [x] if x else mail.findall(v):
            found[place].append(("email", e.lower(), None))
    for blob in page.json_ld:
        try:
            tree = json.loads(blob)
        except ValueError:
            continue
        for field, value in json_contacts(tree):
            if field == "url":
                social(value, "structured")
            else:
                found["structured"].append((field, value.strip().lower() if field == "email" else value.strip(), None))
    for blob in page.scripts:
        for tree in script_json(blob):
            for value in json_profiles(tree):
                social(value, "structured")
        social(blob, "page")
    for prop, value in page.items:
        if prop == "email" and value:
            found["structured"].append(("email", value.removeprefix("mailto:").lower(), None))
        elif prop in ("telephone", "phone") and len(re.sub(r"\D", "", value)) >= 6:
            found["structured"].append(("phone", re.sub(r"[^0-9+() \-]", "", value.removeprefix("tel:")).strip(), None))
    for name, value in page.metas:
        if value:
            social(value, "structured")
            if name in ("email", "og:email", "contact", "reply-to"):
                found["structured"] += [("email", e.lower(), None) for e in mail.findall(value)]
    for text, place in page.text:
        found[place] += [("email", e.lower(), None) for e in mail.findall(_deobfuscate(text))]
        found[place] += [("phone", p.strip(), None) for p in re.findall(PHONE_PATTERN, text) if len(p.strip()) >= 7 and sum(c.isdigit() for c in p) >= 7]
        social(text, place)
    for p in MESSENGER_PATTERNS:  # numbers that stand anywhere in the page's source
        found["page"] += [("whatsapp", "+" + n.lstrip("+"), None) for n in re.findall(p, html)]
    out, seen = [], set()
    for place in ("header", "footer", "structured", "page"):
        for field, value, platform in found[place]:
            key = (field, platform or value)
            if value and key not in seen:
                seen.add(key)
                out.append((field, value, platform, place, len(out)))
    return out


@F.pandas_udf(CONTACT_TYPE)
def html_contacts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """`html -> array<struct<field, value, platform, place, ord>>`."""
    names = ("field", "value", "platform", "place", "ord")
    for s in batches:
        yield s.map(lambda h: [dict(zip(names, c)) for c in contacts(h)])


def contact_links(html: str | None, base: str | None, most: int = 5) -> list[str]:
    """The first links of the same site, in document order, whose path or text speaks of contacts; one per path."""
    if not html or not base:
        return []
    site = urlsplit(base)
    root = f"{site.scheme}://{site.netloc}"
    out: dict[str, str] = {}
    for href, text, _place, _icon in parse_page(html).links:
        if not href or href.startswith(("javascript:", "mailto:", "tel:")):
            continue
        try:
            link = urljoin(base, href)
            path = urlsplit(link).path.lower()
        except ValueError:
            continue
        low = text.strip().lower()
        if link.startswith(root) and path not in out and (any(p in path for p in CONTACT_PATHS) or any(w in low for w in CONTACT_TEXT)):
            out[path] = link
    return list(out.values())[:most]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_contact_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, base in batches:
        yield pd.Series([contact_links(h, b) for h, b in zip(html, base)], dtype=object)


FACTS_TYPE = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("forms", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(FACTS_TYPE)
def html_facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """`html -> struct<title, description, headings, forms>`; a form is its text with the names of its fields."""
    for s in batches:
        rows = []
        for h in s:
            page = parse_page(h or "")
            rows.append((page.title, page.description(), page.headings, page.forms))
        yield pd.DataFrame(rows, columns=FACTS_TYPE.names)


@F.pandas_udf(T.StringType())
def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda h: None if h is None else page_text(h))


LINK_TYPE = "href string, text string, place string"


@F.udtf(returnType=LINK_TYPE)
class HtmlLinks:
    """Table function: the links of a page in document order, made absolute."""

    def eval(self, html: str, base: str):
        if html:
            for href, text, place, _icon in parse_page(html).links:
                yield urljoin(base or "", href), text.strip(), place


@F.udtf(returnType="field string, value string")
class JsonLdContacts:
    """Table function: e-mails, telephones and links of the JSON-LD blocks of a page, in order."""

    def eval(self, html: str):
        for blob in parse_page(html or "").json_ld:
            try:
                tree = json.loads(blob)
            except ValueError:
                continue
            yield from json_contacts(tree)
