"""Template residue and error-page text: exemplar retrieval and TF-IDF containment (problem 5).

Labelled residue exemplars (unfilled slots, filler, error, wait and suspension messages, demands for
scripts) are kept in an inverted index from term to exemplar. The visible text of a page is cut
into passage windows; a window retrieves the exemplars that share a telling term with it, and the
containment is weighed by inverse document frequency both ways: how much of the window the
exemplar explains, and how much of the exemplar the window holds. High coverage excludes the
page. A sentence that merely speaks of such things holds words no exemplar explains.

What differs from case to case is masked to one term: paths, hosts, code names, numbers, and template slots. A slot is
residue wherever it stands, so that exemplar need only be held; filler comes in any order, so that exemplar need
only explain the window. Its words are those of the well-known passage, and what goes with it: words of the pages that
hold the passage's first two words, unless other pages hold them as well (`learn`).

Document frequencies of the exemplars' terms are counted over all pages (the vocabulary is fixed by
the exemplars, so that table has a few hundred rows); pages themselves pass without a shuffle.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.components import ensure_checkpoint_dir
from contactweave.llm.folding import fold

# ---------------------------------------------------------------- fixed values: labelled exemplars
EXEMPLARS = {
    "instruction": """
Insert a short text about your company | Add your own content in this block | Your headline goes here | Sample paragraph - click to edit
Company slogan (replace me) | Write something about yourself | Your text here | Edit this text | Add a subheading here | Replace this file with your own
This is a sample page | Insert image here | Describe your business here | Click here to add a title
Hier steht Ihr Text | Titel hier einfügen | Ihr Text hier | Fügen Sie hier Ihren Text ein | Beschreiben Sie hier Ihr Unternehmen | Klicken Sie hier, um den Text zu bearbeiten
Votre texte ici | Ajoutez ici la description de votre société | Insérez votre titre ici | Cliquez ici pour modifier le texte
Escriba aquí su texto | Inserte aquí su título | Su texto aquí | Haga clic aquí para editar el texto
""",
    "script": """
Please turn on JavaScript to use this site | You must allow scripts and cookies before the content can load | This app needs scripts, and your browser has switched them off
Please enable JavaScript to continue | You need to enable JavaScript to run this app | JavaScript is required | This page requires JavaScript and cookies
Bitte aktivieren Sie JavaScript, um fortzufahren | Ohne Skripte kann diese Anwendung nicht starten | Diese Seite benötigt JavaScript
Veuillez activer JavaScript pour voir ce site | Ce site nécessite JavaScript | Activez JavaScript pour continuer
Active JavaScript en su navegador para continuar | Este sitio necesita JavaScript | Es necesario activar JavaScript
""",
    "wait": """
One moment, we are making sure you are not a robot | Checking the connection before we let you in | Checking your browser before accessing the site | Just a moment | Verifying you are human
Wir prüfen kurz Ihren Browser | Einen Moment, Ihr Browser wird überprüft | Vérification de votre navigateur en cours | Un instant, nous vérifions que vous n'êtes pas un robot
Comprobando que no es un robot | Comprobando su navegador, espere un momento
""",
    "error": """
You may not view this page # | The page you asked for is not here any more # | # nothing lives at this address | Something broke on our side (code #) | Try again in a while
Gateway took too long to reply # | # upstream gave no answer | Could not open the database: too many links in use | Too many requests from your address | Slow down, please
Page not found | # Not Found | # Forbidden | Access denied | Internal Server Error | Service temporarily unavailable | Bad Gateway | The requested page could not be found
Diese Adresse gibt es nicht mehr (Fehler #) | Seite nicht gefunden | Der Verweis ist veraltet | Zugriff verweigert, Ihre Adresse wurde gesperrt | Interner Fehler | Die Anfrage wurde nicht verarbeitet | Dienst vorübergehend nicht verfügbar #
Page introuvable | Elle a peut-être été déplacée | Accès refusé à cette ressource | Erreur interne du serveur, réessayez plus tard | Erreur #: cette adresse n'existe pas | Trop de requêtes | Service indisponible
No encontramos la página que busca | Acceso denegado: límite de visitas superado | Error #: la dirección no existe | Error interno: no hay conexión con la base de datos | Página no encontrada | Demasiadas solicitudes | Servicio no disponible
Fatal error: Uncaught TypeError in §path | Template render error: filter not found: §name §loc | Warning: Undefined variable §name in §path on line # | Notice: Trying to read property §name of null in §path on line #
Traceback (most recent call last): File §path, line #, in render | §host nullpointerexception at §path | java lang nullpointerexception at §path
""",
    "placeholder_site": """
Our new website is under construction | This account has been suspended by the provider | Domain §host is parked and may be for sale | Congratulations! The web server was installed and runs | The web server was installed and runs
Coming soon | This site is under construction | This domain is for sale | Hier entsteht eine neue Internetpräsenz | Diese Seite befindet sich im Aufbau | Diese Domain steht zum Verkauf
Site en maintenance, revenez bientôt | Site en construction | Ce domaine est à vendre | Sitio en construcción | Sitio en mantenimiento, vuelva pronto | Este dominio está en venta
""",
}
#: The well-known passage of pseudo-Latin filler, and the words that give it away.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
FILLER_SIGNS = ("lorem", "ipsum")
#: Words that name a field of a template.
FIELD_WORDS = frozenset(
    "name first last full company business firm organisation organization city town street address email mail phone telephone number fax zip postal postcode code country region state date year title "
    "subtitle headline slogan service services opening hours hour logo url website site owner contact description text image price your insert here placeholder content customer client user".split()
)

MIN_WINDOW_COVER = 0.72
MIN_EXEMPLAR_COVER = 0.6
#: Kinds of exemplars with coverages of their own: least share of the window, least share of the exemplar, least terms of the window.
COVERS = {"filler": (0.85, 0.0, 4), "slot": (0.0, 1.0, 1)}
UNKNOWN_IDF = math.log(100)
MAX_IDF = 5.0

_DROP = re.compile(r"<!--.*?-->|<(script|style|template|svg|head|title|code|textarea|option|select)\b[^>]*>.*?</\1\s*>|<\?.*?\?>|<!doctype[^>]*>", re.S | re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.S | re.I)
_INLINE = re.compile(r"</?(?:b|i|em|strong|span|a|u|small|big|font|mark|sub|sup|abbr|q|cite)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_SENTENCE = re.compile(r"([.!?…])\s+")

_SLOT = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\{%[^%]{1,60}%\}|\$\{[^{}]{1,40}\}|<%.{1,60}?%>|\*\|[^|]{1,40}\|\*|\[\[[^\[\]]{1,40}\]\]|##[A-Za-z_ ]{2,40}##|%%[A-Za-z_ ]{2,40}%%"
)
_NAMED = re.compile(r"%([A-Za-z_]{2,40})%|\[([A-Za-z_ ]{2,40})\]|\{([A-Za-z_ ]{2,40})\}|__([A-Z_]{2,40})__|<([A-Za-z_ ]{3,40})>")
_BRACKET = re.compile(r"[{\[%$*#_<]")
_PATH = re.compile(r"\"?(?:/[\w.\-]+){2,}(?::\d+)?\"?|\b(?:[A-Za-z_]\w*\.){2,}\w+\([\w.]+:\d+\)")
_HOSTNAME = re.compile(r"\b(?:[\w\-]+\.)+[a-z]{2,}\b(?!\()")
_LOCATION = re.compile(r"\(\w+:\d+\)")
_CODE_NAME = re.compile(r"\$\w+|\"\w+\"(?= of null)|(?<=found: )\w+")
_INNER_DOT = re.compile(r"\w\.[a-z]")
_TOKEN = re.compile(r"§\w+|[^\W\d_]+|\d+")
_BLANKS = re.compile(r"[ \t\r\f\xa0]+")
_MASKS = (("§path", _PATH), ("§host", _HOSTNAME), ("§loc", _LOCATION), ("§name", _CODE_NAME))



def visible(page: str) -> str:
    """Visible text, a line per block. A noscript counts only where a page shows no other text."""
    body = _DROP.sub(" ", page)
    text = html_lib.unescape(_TAG.sub("\n", _INLINE.sub(" ", _NOSCRIPT.sub(" ", body))))
    if not text.strip():
        text = html_lib.unescape(_TAG.sub("\n", _INLINE.sub(" ", " \n".join(_NOSCRIPT.findall(body)))))
    return _BLANKS.sub(" ", text)


def passages(page: str | None) -> list[str]:
    """Windows of visible text: its sentences and lines."""
    return [w for w in map(str.strip, _SENTENCE.sub("\\1\n", visible(page)).split("\n")) if w] if page else []


def page_terms(page: str) -> set[str]:
    """Distinct folded words of a page, and the masks that occur in it."""
    text = visible(page)
    found = set(_TOKEN.findall(fold(text)))
    numbers = {t for t in found if t.isdigit()}
    if numbers:
        found -= numbers
        found.add("#")
    found.update(mask for mask, pattern in _MASKS if pattern.search(text))
    return found


def _named_slot(m: re.Match) -> str:
    words = re.split(r"[_ ]+", next(g for g in m.groups() if g).lower())
    return " §slot " if all(w in FIELD_WORDS for w in words if w) else m[0]


def terms(window: str) -> list[str]:
    """Folded terms; template slots, numbers, paths, hosts and code names are masked."""
    s = window
    if _BRACKET.search(s):
        s = _NAMED.sub(_named_slot, _SLOT.sub(" §slot ", s))
    if "/" in s or "(" in s:
        s = _PATH.sub(" §path ", s)
        s = _LOCATION.sub(" §loc ", s)
    if "$" in s or '"' in s or "found: " in s:
        s = _CODE_NAME.sub(" §name ", s)
    if _INNER_DOT.search(s):
        s = _HOSTNAME.sub(" §host ", s)
    return ["#" if t.isdigit() else t for t in _TOKEN.findall(fold(s))]


def exemplar_terms() -> list[tuple[str, list[str]]]:
    """(kind, terms) of every exemplar."""
    out = []
    for kind, block in EXEMPLARS.items():
        for line in block.strip().splitlines():
            for text in line.split("|"):
                if text.strip():
                    out.append((kind, [("#" if t == "#" else t) for t in _TOKEN.findall(fold(text.replace("#", " 0 ")))]))
    return [(k, ["#" if t == "0" else t for t in ts]) for k, ts in out]


class Index:
    """Inverted index over the exemplars with the weights of their terms; `filler`: learned filler words."""

    def __init__(self, idf: dict[str, float] | None = None, filler: Iterable[str] = ()):
        self.idf = idf or {}
        self.exemplars: list[tuple[str, frozenset[str]]] = [(k, frozenset(ts)) for k, ts in exemplar_terms()]
        self.exemplars += [("filler", frozenset(FILLER) | frozenset(filler)), ("slot", frozenset(["§slot"]))]
        self.index: dict[str, list[int]] = {}
        self.weight: list[float] = []
        self.cover: list[tuple[float, float, int]] = []
        self.telling: set[str] = set()
        for i, (kind, s) in enumerate(self.exemplars):
            self.weight.append(sum(self.of(t) for t in s))
            self.cover.append(COVERS.get(kind, (MIN_WINDOW_COVER, MIN_EXEMPLAR_COVER, 1)))
            for t in s:
                self.index.setdefault(t, []).append(i)
            # without any of an exemplar's heavier half of terms a window can't hold most of its weight
            least = self.cover[i][1]
            self.telling |= s if least < 0.5 else set(sorted(s, key=lambda t: (-self.of(t), t))[: max(2, len(s) // 2 + 1)])

    def of(self, term: str) -> float:
        return self.idf.get(term, UNKNOWN_IDF)

    def match(self, window: str) -> str | None:
        """Kind of residue in the window, or None."""
        ts = set(terms(window))
        if ts.isdisjoint(self.telling):
            return None
        total = 0.0
        seen: dict[int, float] = {}
        for t in ts:
            w = self.of(t)
            total += w
            for i in self.index.get(t, ()):
                seen[i] = seen.get(i, 0.0) + w
        slack = 1e-9 * total
        for i, w in seen.items():
            of_window, of_exemplar, least = self.cover[i]
            if len(ts) >= least and w + slack >= of_window * total and w + slack >= of_exemplar * self.weight[i]:
                return self.exemplars[i][0]
        return None


def vocabulary() -> frozenset[str]:
    return frozenset(t for _, ts in exemplar_terms() for t in ts) | frozenset(FILLER)


def _term_counts(pages: DataFrame, html_col: str, words: frozenset[str] | None) -> DataFrame:
    """(t, signed, n): in how many pages each of the given words occurs (None: any word); '' counts the pages.

    `signed` tells pages with all filler signs from the others.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for h in s:
                ts = page_terms(h)
                mark = "+" if ts.issuperset(FILLER_SIGNS) else "-"
                out.append([mark + t for t in (ts if words is None else ts & words)] + [mark])
            yield pd.Series(out, dtype=object)

    counted = pages.select(F.explode(known.asNondeterministic()(F.col(html_col))).alias("x")).groupBy("x").count()
    return counted.select(F.substring("x", 2, 1 << 30).alias("t"), F.col("x").startswith("+").alias("signed"), F.col("count").alias("n"))


def learn(pages: DataFrame, html_col: str = "html", only: float = 0.3, share: float = 0.01) -> tuple[dict[str, float], list[str]]:
    """(inverse document frequencies, learned filler words) over all pages.

    Candidates are the words of at least `share` of the pages that hold all filler signs (two pages at
    least), no more than (words of such a page) / `share`; a candidate is filler when at least `only` of all
    pages that hold it are such pages. One row a word of the fixed vocabulary and one a candidate come to the driver.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    vocab = vocabulary()
    shown = pages.filter(F.length(html_col) > 0)
    low = F.lower(html_col)
    signed = _term_counts(shown.filter(low.contains(FILLER_SIGNS[0]) & low.contains(FILLER_SIGNS[1])), html_col, None).filter("signed").checkpoint()
    total = signed.filter("t = ''").select("n").first()
    least = max(2, math.ceil(share * total[0])) if total else 2
    candidates = {r["t"] for r in signed.filter((F.col("n") >= least) & (F.col("t") != "")).select("t").collect() if r["t"] not in vocab and r["t"][0] not in "#§"}
    counts: dict[str, int] = {}
    beside: dict[str, int] = {}
    for r in _term_counts(shown, html_col, vocab | candidates).collect():
        counts[r["t"]] = counts.get(r["t"], 0) + r["n"]
        if r["signed"]:
            beside[r["t"]] = r["n"]
    n = counts.pop("", 0)
    filler = sorted(t for t in candidates if beside.get(t, 0) >= only * counts.get(t, 1))
    return {t: min(MAX_IDF, math.log((n + 1) / (c + 1))) + 0.05 for t, c in counts.items() if t in vocab}, filler


def residue_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`page_id` and `kinds` (sorted) of pages whose visible text holds residue in any part.

    Null and empty pages, and pages without visible text, are no case.
    """
    idf, filler = learn(pages, html_col)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, memo = Index(idf, filler), {}

        def one(window: str):
            if window not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[window] = index.match(window)
            return memo[window]

        for s in batches:
            yield s.map(lambda h: sorted({k for w in passages(h) if (k := one(w))}))

    return (
        pages.filter(F.length(html_col) > 0)
        .select("page_id", kinds.asNondeterministic()(F.col(html_col)).alias("kinds"))
        .filter(F.size("kinds") > 0)
    )
