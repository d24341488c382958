"""Levels of a postal address written freely: street, number, building and the town in its tail.

Pure Python on one value; the operators call it Arrow-batched. Postal codes
are recognised and left out, the type of street is kept apart because people
leave it out. Units are kept apart too, as they don't make another place.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from contactweave.llm.encoding_repair import repair
from contactweave.llm.folding import fold

#: Words for kinds of streets, folded, and the kind they stand for (fixed values).
STREET_TYPES = {
    "road": "road", "rd": "road", "avenue": "avenue", "ave": "avenue", "av": "avenue", "avenida": "avenue", "avda": "avenue",
    "street": "street", "st": "street", "str": "street", "strasse": "street", "straat": "street", "square": "square", "sq": "square",
    "lane": "lane", "ln": "lane", "la": "lane", "rue": "rue", "r": "rue", "place": "place", "pl": "place", "platz": "place",  # one word in four languages, one abbreviation
    "boulevard": "boulevard", "bd": "boulevard", "boul": "boulevard", "blvd": "boulevard", "paseo": "paseo", "pso": "paseo",
    "plaza": "place", "pza": "place", "plza": "place", "via": "via", "v": "via", "viale": "viale", "vle": "viale", "corso": "corso", "cso": "corso",
    "piazza": "place", "pzza": "place", "gasse": "gasse", "g": "gasse", "weg": "weg", "wg": "weg", "calle": "calle", "cl": "calle", "c": "calle", "allee": "allee",
    "drive": "drive", "dr": "drive", "way": "way", "court": "court", "ct": "court", "close": "close", "po": "paseo",
}
#: Endings that German street names carry in the same word (fixed values), longest first.
GLUED = ("strasse", "platz", "gasse", "allee", "weg", "str", "pl", "wg", "g")
BUILDING = {"house", "hse", "haus", "hs", "residence", "res", "edificio", "edif", "palazzo", "pal", "building", "bldg", "tower", "mansion"}

_UNIT = re.compile(r"\b(?:unit|apt|apartment|flat|suite|ste|floor|shop|office|room|level|top|stiege|piso|interno|etage)\b\.?\s*(?:n[ro]?[.º]?\s*|#\s*)?\d+[a-z]?\b|\b\d+(?:st|nd|rd|th)\s+floor\b")
_POSTAL = re.compile(r"\b[a-z]{3,4} \d{4}\b|(?<!# )\b\d{5}\b|(?<!# )\b\d{4} ?[a-z]{2}\b")
_NUMBER = re.compile(r"(?:#|\bn(?:[ro]?\.|º|o|r|um)?\s*)?\s*\b(\d+)(?:\s*[-/ ]?\s*([a-z])(?![\w?�]))?(?![\w?�])", re.I)
_MARK = re.compile(r"(?:#|\bn(?:º|[ro]\.?|°)|\bn\?|n\ufffd|\bnum\.?)\s*(?=\d)")


class Place(NamedTuple):
    """Parsed levels; empty strings where a level is missing."""

    street: str
    kind: str
    number: str
    building: str
    tail: str
    unit: str = ""


NOWHERE = Place("", "", "", "", "")
_SUBS = tuple(
    (re.compile(a), b)
    for a, b in (
        (r"stra[?\ufffd]e", "strasse"), (r"\bp\.\s?º|\bp\.[?\ufffd]", "paseo "), (r"\bc/\s*", "calle "), (r"\bv\.le\b", "viale"), (r"\bc\.so\b", "corso"), (r"\bp\.za\b|\bp\.zza\b", "piazza"),
    )
)
_LEADING = re.compile(r"^[\s,\d]+")
_DOTTED = re.compile(r"(?<=[a-z])\.(?=[a-z])")
_PART = re.compile(r"\s*,\s*|\s+-\s+")
_WORD = re.compile(r"[\s.]+")
_HYPHENED = re.compile(r"-(?:%s)$" % "|".join(STREET_TYPES))
_NO_NAME = re.compile(r"[^a-z0-9?\ufffd\u0370-\u04ff]")



def _strip_glued(word: str) -> tuple[str, str]:
    for end in GLUED:
        if word.endswith(end) and len(word) - len(end) >= 5:
            return word[: -len(end)], STREET_TYPES[end] if len(end) > 2 else ""  # two letters may belong to the name
    return word, ""


def parse(text: str | None) -> Place:
    """Levels of a street value."""
    if text is None or not text.strip():
        return NOWHERE
    s = fold(repair(text)[0])
    for pattern, kind in _SUBS:
        s = pattern.sub(kind, s)
    unit = _UNIT.search(s)
    s = _UNIT.sub(" ", s)
    s = _MARK.sub(" # ", s)
    tail = ""
    codes = list(_POSTAL.finditer(s))
    if codes and codes[0][0].isdigit() and not s[: codes[0].start()].strip(" ,#") and len(_NUMBER.findall(s)) == 1:
        codes = codes[1:]  # the only number, before the street: a long house number
    if codes:
        tail = _LEADING.sub("", s[codes[-1].end() :]).strip(" ,.;")
        s = s[: codes[0].start()] + " "
    number = ""
    found = [n for n in _NUMBER.finditer(s)]
    if found:
        best = next((n for n in found if "#" in s[max(0, n.start() - 3) : n.start() + 2]), found[0])
        number = best[1].lstrip("0") + (best[2] or "")
        s = s[: best.start()] + " , " + s[best.end() :]
    s = s.replace("#", " ")
    s = _DOTTED.sub(". ", s)
    building, street, kind, loose = [], [], "", []
    for part in _PART.split(s):
        words = [w for w in _WORD.split(part) if w and w != "-"]
        if "-" in part:
            words = [x for w in words for x in (w.split("-") if _HYPHENED.search(w) else [w.replace("-", "")])]
        words = [w for w in words if w]
        if not words:
            continue
        at = next((i for i, w in enumerate(words) if w in BUILDING), None)
        if at is not None:
            # the building's name is the word after a leading kind word, else the word before it
            if at == 0 and len(words) > 1:
                building.append(words[1])
                words = words[2:]
            elif at + 1 < len(words) and (words[at - 1] in STREET_TYPES or (at > 1 and words[0] in STREET_TYPES)):
                building.append(words[at + 1])
                words = words[:at] + words[at + 2 :]
            elif at > 0:
                building.append(words[at - 1])
                words = words[: at - 1] + words[at + 1 :]
            else:
                words = []
            if not words:
                continue
        names = []
        for i, w in enumerate(words):
            if w in STREET_TYPES and len(words) > 1 and (i == 0 or i == len(words) - 1 or len(w) > 1):
                kind = kind or STREET_TYPES[w]
            elif w in STREET_TYPES and len(w) > 1:
                kind = kind or STREET_TYPES[w]
            else:
                names.append(w)
        if names:
            loose.append("".join(_NO_NAME.sub("", w) for w in names))
    if loose:
        street = loose[0]
        if not kind:
            street, kind = _strip_glued(street)
        if len(loose) > 1 and not tail:
            tail = loose[-1]
    else:
        street = ""
    return Place(street or "", kind, number, building[0] if building else "", tail, " ".join(unit[0].split()) if unit else "")
