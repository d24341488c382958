"""Garbled text from wrong character encoding: round-trip repair (problem 7).

A value is re-encoded under each candidate legacy encoding and the bytes are decoded, strictly,
under the encodings it may have been typed in; this is repeated for nested layers. A step is
accepted when the garbling cost drops. The cost counts what typed names never hold: C1
controls, replacement characters, letters beside symbols that belong to no word, and changes of
script inside a word. Values whose letters were lost for good (a replacement character, or a
question mark where a letter or a quote stood) are found without a repair.

The operator is one narrow pass. A JVM-side filter lets only values through that hold a
character beyond ASCII or a question mark; those go Arrow-batched to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidate (misread as, typed in) pairs (fixed values): UTF-8 under each legacy encoding, then
#: the single-byte pairs between platforms.
PAIRS = tuple(
    (legacy, "utf-8")
    for legacy in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "koi8-r")
) + (
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
)
_ADJACENT = re.compile(r"[^\x00-\x7f]{2}")

_LOST = re.compile(
    r"\ufffd"
    r"|(?<=[^\W\d_])\?+(?=[^\W\d_])"  # letters lost inside a word
    r"|(?:^|(?<=[\s(\-]))\?+(?=[^\W\d_])"  # a word's first letter or an opening quote lost
    r"|(?<=\S)\s+\?+(?=\s|$)"  # a dash between two parts or a sign after them lost
    r"|\d\?|^\?+\s"
    r"|(?<=\S\s)[^\s?]*[^\W\d_]\?+(?=[\s,]|$)"  # the end of a word that opens no question
    r"|\b[Nn]\?(?=\s*\d)"  # the ordinal sign of a house number
    r"|[bcdfghjklmnpqtvwxz]r\?(?=[\s,])"  # an end that can't be spoken
)
#: Signs that stand in typed names; every other symbol beyond ASCII costs.
_TYPED_SIGNS = frozenset("•©®™–—…‘’“”„«»‹›½¼¾°º²³&·€№")


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    """Class of one character: script letter, digit, plain ASCII, or sign."""
    o = ord(c)
    if o < 128:
        return "a" if c.isalpha() else "d" if c.isdigit() else "p"
    if 0x80 <= o <= 0x9F or c == "�":
        return "c"
    cat = unicodedata.category(c)
    if cat[0] == "L" and cat != "Lo":
        name = unicodedata.name(c, "")
        script = name.split(" ", 1)[0]
        return {"LATIN": "l", "GREEK": "g", "CYRILLIC": "y"}.get(script, "o")
    if cat == "Lo":
        return "s" if c in "ªº" else "o"
    return "m" if cat[0] == "M" else "s"


@lru_cache(maxsize=4096)
def _lead(c: str) -> bool:
    """The byte of this character in the Western code page opens a UTF-8 sequence."""
    return 0xC2 <= ord(c) <= 0xF4


@lru_cache(maxsize=4096)
def _follows(c: str) -> bool:
    """The byte of this character in the Western code page continues a UTF-8 sequence."""
    if ord(c) < 0x80:
        return False
    try:
        return 0x80 <= c.encode("cp1252")[0] <= 0xBF
    except UnicodeEncodeError:
        return 0x80 <= ord(c) <= 0x9F


_OPENS = {"”": "“", "’": "‘", "»": "«"}
_OPENERS = "‘«‹„‚"


def _closes(text: str, i: int) -> bool:
    """The character at i closes a quote that was opened before it, so it stands for itself."""
    opener = _OPENS.get(text[i])
    return opener is not None and text.count(opener, 0, i) > text.count(text[i], 0, i)


def garble_cost(text: str) -> int:
    """0 for text as people type it; grows with every sequence that only a misreading makes."""
    cost = 0
    prev = " "
    word: set[str] = set()
    for i, c in enumerate(text):
        k = _kind(c)
        if k == "c":
            cost += 4
        elif k == "s":
            nxt = text[i + 1] if i + 1 < len(text) else " "
            beside = _kind(prev) in "algyo" or _kind(nxt) in "algyo" or _kind(prev) == "s" or _kind(nxt) == "s"
            if c not in _TYPED_SIGNS:
                cost += 2 + beside
        elif k == "o" or c == "ƒ":
            cost += 2
        if ord(prev) >= 0xC2 and _lead(prev) and _follows(c) and not _closes(text, i):
            cost += 2
        if "\ufb00" <= c <= "\ufb06":
            cost += 2  # a printer's ligature, which no one types
        if c in _OPENERS and (i == 0 or prev == " ") and text[i + 1 : i + 2].islower() and not any(x in text[i:] for x in _OPENS):
            cost += 1  # a quote that opens inside a word and never closes
        if c in "…—" and (i == 0 or prev == " ") and text[i + 1 : i + 2].isalpha():
            cost += 1  # a sign for a word's first letter
        if ord(c) > 127 and c.islower() and (i == 0 or prev == " "):
            after = text[i + 1 : i + 2]
            if after.isupper() or (c in "ñï" and after in ("", " ")):
                cost += 1  # a letter for an opening quote or a dash
        if k in "algyo":
            word.add("l" if k in "al" else k)
            if c.isupper() and ord(c) > 127 and prev.isalpha() and (prev.islower() or text[i + 1 : i + 2].islower()):
                cost += 1  # a capital beyond ASCII inside a word
        elif word:
            cost += 2 * (len(word) - 1)
            word = set()
        prev = c
    return cost + 2 * max(0, len(word) - 1)


def _encode(text: str, legacy: str) -> bytes | None:
    """Bytes of the text as read under `legacy`; bytes undefined there were read as C1 controls."""
    try:
        return text.encode(legacy)
    except UnicodeEncodeError:
        pass
    if legacy not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):
        return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(legacy)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _pieces(text: str, legacy: str) -> str | None:
    """Repair only the spans beyond ASCII that round-trip, when the whole value does not."""
    changed = False

    def one(m: re.Match) -> str:
        nonlocal changed
        if any(_closes(text, k) for k in range(m.start(), m.end())):
            return m[0]
        raw = _encode(m[0], legacy)
        if raw is None:
            return m[0]
        try:
            fixed = raw.decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        changed = changed or fixed != m[0]
        return fixed

    out = re.sub(r"[^\x00-\x7f]{2,}", one, text)
    return out if changed else None


_LOWER = "".join(chr(o) for o in range(0xDF, 0x250) if chr(o).islower() and o != 0x192)
_UPPER = "".join(chr(o) for o in range(0xC0, 0x250) if chr(o).isupper())
#: Text that costs nothing whatever it was read as: accented letters alone among plain ones.
_PLAIN = re.compile(rf"(?:[\x00-\x7f]|(?<=[a-z])[{_LOWER}](?![^\x00-\x7f])|(?<![^\W\d_])(?<![^\x00-\x7f])[{_UPPER}](?=[a-z]))*+")


def repair(text: str, pairs: Sequence[tuple[str, str]] = PAIRS) -> tuple[str, list[str]]:
    """Text as typed, as far as it can be given back, and the layers undone (empty: untouched)."""
    if text.isascii() or _PLAIN.fullmatch(text):
        return text, []
    layers: list[str] = []
    cost = garble_cost(text)
    while not text.isascii():  # every layer shortens the text or lowers its cost, so this ends
        adjacent = _ADJACENT.search(text) is not None
        if not cost and not adjacent:
            break
        best: tuple | None = None
        for rank, (legacy, target) in enumerate(pairs):
            raw = _encode(text, legacy)
            fixed, whole = None, True
            if raw is not None:
                try:
                    fixed = raw.decode(target)
                except UnicodeDecodeError:
                    pass
            if fixed is None and target == "utf-8":
                fixed, whole = _pieces(text, legacy), False
            if fixed is None or fixed == text:
                continue
            now = garble_cost(fixed)
            # A whole value that decodes strictly as UTF-8 is proof enough at an equal cost.
            if now < cost or (whole and target == "utf-8" and adjacent and now == cost):
                key = (target != "utf-8", now, not whole, rank)
                if best is None or key < best[0]:
                    best = (key, fixed, f"{legacy}>{target}" + ("" if whole else " in part"))
        if best is None:
            break
        text, cost = best[1], best[0][1]
        layers.append(best[2])
    return text, layers


def lost(text: str) -> bool:
    """Letters or signs are gone for good and only their stand-ins are left."""
    return _LOST.search(text) is not None


_FIX = T.StructType(
    [
        T.StructField("restored", T.StringType()),
        T.StructField("layers", T.ArrayType(T.StringType())),
        T.StructField("lost", T.BooleanType()),
        T.StructField("garbled", T.BooleanType()),
    ]
)


def fix(text: str | None) -> tuple:
    if text is None:
        return None, [], False, False
    restored, layers = repair(text)
    gone = lost(restored)
    return restored, layers, gone, bool(layers) or gone or garble_cost(restored) >= 3


@F.pandas_udf(_FIX)
def repair_udf(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in values:
        yield pd.DataFrame([fix(x) for x in s], columns=["restored", "layers", "lost", "garbled"])


repair_udf = repair_udf.asNondeterministic()

_SUSPECT = r"[^\x00-\x7f]|\?"


def repaired(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per altered value: id, field_name, value, restored (null if nothing could be given back), layers, lost.

    Null and empty values are never altered. A value that is only partly recoverable is given
    back in part and keeps `lost`. No shuffle and no cap: every value of every row is tested.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields])
    )
    return (
        df.select(F.col(f"`{id_col}`").alias(id_col), pairs.alias("p"))
        .filter(F.col("p.value").rlike(_SUSPECT))
        .select(id_col, "p.field_name", "p.value", repair_udf(F.col("p.value")).alias("fix"))
        .filter("fix.garbled")
        .select(
            id_col,
            "field_name",
            "value",
            F.when(F.size("fix.layers") > 0, F.col("fix.restored")).alias("restored"),
            F.col("fix.layers").alias("layers"),
            F.col("fix.lost").alias("lost"),
        )
    )
