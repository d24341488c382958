"""Several values packed in one field: dictionary-guided segmentation (problem 2).

A multi-pattern automaton (Aho-Corasick) over the dictionary of known whole values runs over the
field; every hit that begins and ends at a delimiter, a quote or the field's end is an arc of a
known value, whatever delimiters it holds. Other arcs are single pieces between delimiters, runs of
pieces that have the field's shape, and stretches that have not. A dynamic program picks the
cheapest cover: a known value is cheapest, a value of the right shape next, anything else dear. A
field is packed when its best cover holds two or more values.

The dictionaries (one a field) are not lists in the code: they are counted over the whole columns,
from places where a value's limits are certain (quoted items, items between hard delimiters, fields
without any delimiter). An entry needs a share of at least `min_share` of all counted items, so a
dictionary can't exceed 1 / `min_share` entries whatever the size of the corpus; that is the proof of
the bound under which it is shipped to the executors. E-mail addresses and phone numbers are nearly
unique, so their dictionaries hold what is shared by many rows and shape decides about the rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiters (fixed values). Hard ones never occur inside a value; soft ones may.
HARD = r"\|\||[;|\t\n\r•·]"
SOFT_CATEGORY = r"\s*,\s*|\s+/\s+|\s+(?:&|-|(?i:and|or|und|oder))\s+|/"
#: Soft ones that join words inside a value as often as values; they cut only between known values.
WEAK = r"\s+(?:&|-|(?i:and|or|und|oder))\s+"
SOFT_CONTACT = r"\s*,\s*|\s*/\s*|\s+&\s+|\s+(?i:and|or|und|et|y|e|o|ou|oder)\s+|\s+"

EMAIL_SHAPE = re.compile(r"[^\s@,;|/<>\"']+@[^\s@,;|/<>\"']+\.[^\s@,;|/<>\"'.]{2,}")
PHONE_SHAPE = re.compile(r"[0-9 +()\-./]+(?:ext\.? ?\d+)?", re.I)
PHONE_PART = re.compile(r"[0-9 +()\-./]*(?:e(?:x(?:t(?:\.? ?\d*)?)?)?)?", re.I)
_EXTENSION = re.compile(r"(?i)ext.*$")
_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}

COST_KNOWN, COST_SHAPE, COST_OTHER = 1, 4, 40


def is_email(v: str) -> bool:
    return EMAIL_SHAPE.fullmatch(v) is not None


def _phone_digits(v: str) -> int:
    return sum(c.isdigit() for c in _EXTENSION.sub("", v))


def is_phone(v: str) -> bool:
    """7 to 15 digits and signs between them, at most 400 letters in all."""
    return len(v) <= 400 and PHONE_SHAPE.fullmatch(v) is not None and 7 <= _phone_digits(v) <= 15


def may_be_phone(v: str) -> bool:
    """`v` may be a part of a phone number."""
    return len(v) <= 400 and PHONE_PART.fullmatch(v) is not None and _phone_digits(v) <= 15


def never_longer(v: str) -> bool:
    """No value of this kind holds a delimiter."""
    return False


def _unquote(v: str) -> str:
    v = v.strip()
    while len(v) >= 2 and v[0] in _QUOTES and v[-1] == _QUOTES[v[0]]:
        v = v[1:-1].strip()
    return v


def _lower(text: str) -> str:
    """Lower case of the same length, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Segmenter:
    """Cheapest cover of one field.

    `known`: whole values; `shape`: test of a lone value (None: any piece will do, weak delimiters may
    stay inside); `begins`: whether a run of pieces can still grow into a value of the shape.
    """

    def __init__(self, soft: str, known: Sequence[str] = (), shape: Callable | None = None, begins: Callable = never_longer):
        self.cut = re.compile(rf"\s*(?:{HARD})\s*|{soft}")
        self.hard = re.compile(HARD)
        self.weak = re.compile(WEAK)
        self.shape, self.begins = shape, begins
        self.automaton = None
        if known:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k in known:
                self.automaton.add_word(_lower(k), len(k))
            self.automaton.make_automaton()

    def _quoted(self, text: str) -> list[tuple[int, int]]:
        """Spans in quotes that stand alone between delimiters."""
        spans, i, n, starts = [], 0, len(text), True
        while i < n:
            c = text[i]
            if starts and c in _QUOTES:
                end = text.find(_QUOTES[c], i + 1)
                while 0 <= end < n - 1 and not self.cut.match(text, end + 1):
                    end = text.find(_QUOTES[c], end + 1)
                if end > 0:
                    spans.append((i, end + 1))
                    i, starts = end + 1, False
                    continue
            m = self.cut.match(text, i)
            if m and m.end() > i:
                i, starts = m.end(), True
            else:
                i, starts = i + 1, starts and c.isspace()
        return spans

    def _pieces(self, text: str) -> tuple[list[tuple[int, int]], list[str]]:
        """Spans between all possible cuts outside quotes, and the kind of the cut behind each but the last: hard, weak or soft."""
        quoted = self._quoted(text) if any(q in text for q in _QUOTES) else []
        spans, kinds, at, left, q = [], [], 0, 0, 0
        while m := self.cut.search(text, at):
            while q < len(quoted) and quoted[q][1] <= m.start():
                q += 1
            if q < len(quoted) and quoted[q][0] <= m.start() < quoted[q][1]:
                at = quoted[q][1]
                continue
            spans.append((left, m.start()))
            kinds.append("hard" if self.hard.search(m[0]) else "weak" if self.weak.fullmatch(m[0]) else "soft")
            left, at = m.end(), max(m.end(), at + 1)
        spans.append((left, len(text)))
        return spans, kinds

    def _known_arcs(self, text: str, spans: list[tuple[int, int]], hard_before: list[int]) -> dict[int, list[int]]:
        """Automaton hits that cover whole pieces: last piece -> first pieces. Quotes and blanks around the pieces don't count."""
        arcs: dict[int, list[int]] = {}
        if self.automaton is None:
            return arcs
        starts, ends = {}, {}
        for i, (a, b) in enumerate(spans):
            while a < b and (text[a].isspace() or text[a] in _QUOTES):
                starts[a] = i
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in "\"'”»"):
                ends[b] = i
                b -= 1
            starts[a] = ends[b] = i
        for last, size in self.automaton.iter(_lower(text)):
            i, j = starts.get(last + 1 - size), ends.get(last + 1)
            if i is not None and j is not None and i <= j and hard_before[i] == hard_before[j]:
                arcs.setdefault(j, []).append(i)
        return arcs

    def split(self, text: str | None) -> list[str]:
        """Values of the field in written order; empty items are dropped, repeats are kept."""
        if text is None:
            return []
        text = text.strip()
        if len(text) >= 2 and text[0] == "[" and text[-1] == "]":
            text = text[1:-1].strip()
        if not text:
            return []
        spans, kinds = self._pieces(text)
        n = len(spans)
        if n == 1:
            v = _unquote(text)
            return [v] if v else []
        hard_before = [0] * n
        for i in range(1, n):
            hard_before[i] = hard_before[i - 1] + (kinds[i - 1] == "hard")
        known = self._known_arcs(text, spans, hard_before)
        far = 1 << 60
        best: list[tuple[int, int]] = [(0, -1)] + [(far, -1)] * n  # cheapest cover of the first j pieces, its last arc's first piece
        stretch = (far, 0)  # a dear arc that is still open: cost, first piece

        def offer(j: int, cost: int, i: int) -> None:
            if cost < best[j][0]:
                best[j] = (cost, i)

        run = (far, 0)  # cheapest beginning in the run of pieces that only weak cuts join
        for j in range(1, n + 1):
            last = j - 1
            if (last and kinds[last - 1] != "weak") or best[last][0] <= run[0]:
                run = (best[last][0], last)
            if not _unquote(text[spans[last][0] : spans[last][1]]):
                offer(j, best[last][0], last)  # nothing between two delimiters
            for i in known.get(last, ()):
                offer(j, best[i][0] + COST_KNOWN, i)
            if self.shape is None:
                # an unknown value may hold the weak delimiters between its words, no other ones
                offer(j, run[0] + COST_SHAPE, run[1])
            else:
                i = last
                while i >= 0 and hard_before[i] == hard_before[last]:
                    v = _unquote(text[spans[i][0] : spans[last][1]])
                    if self.shape(v):
                        offer(j, best[i][0] + COST_SHAPE, i)
                    if not self.begins(v):
                        break
                    i -= 1
                if last and kinds[last - 1] == "hard":
                    stretch = (far, last)
                if best[last][0] + COST_OTHER < stretch[0]:
                    stretch = (best[last][0] + COST_OTHER, last)
                offer(j, *stretch)
        out, j = [], n
        while j > 0:
            i = best[j][1]
            out.append(_unquote(text[spans[i][0] : spans[j - 1][1]]))
            j = i
        return [v for v in reversed(out) if v]


#: Fields of the listing table: soft delimiters, shape of a lone value, test of its beginning.
FIELDS: dict[str, tuple[str, Callable | None, Callable]] = {
    "google_business_categories": (SOFT_CATEGORY, None, never_longer),
    "email": (SOFT_CONTACT, is_email, never_longer),
    "phone_number": (SOFT_CONTACT, is_phone, may_be_phone),
}


def count_dictionaries(df: DataFrame, fields: Sequence[str], min_share: float = 1e-4, min_count: int = 2) -> dict[str, list[str]]:
    """Known whole values of each column, lower case, from all rows in one pass; at most 1 / min_share entries each.

    Items come from certain places: fields cut at hard delimiters and at quotes. An item of a field
    without a shape that holds a soft delimiter is known only if it stands alone in a field or in
    quotes and its parts aren't all known themselves; where values have a shape, the item must have it.
    """

    def items_of(col: str):
        body = F.regexp_replace(F.col(f"`{col}`"), r"^\s*\[|\]\s*$", "")
        quoted = F.regexp_extract_all(body, F.lit(r'(?:^|[;,|\[\s])"([^"]+)"'), F.lit(1))
        bare = F.split(F.regexp_replace(body, r'"[^"]*"', ";"), HARD)
        found = F.coalesce(F.concat(quoted, bare), F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(F.lit(col).alias("field"), F.lower(F.regexp_replace(F.trim(x), r"^['\s,]+|['\s,]+$", "")).alias("item")))

    counted = (
        df.select(F.explode(F.concat(*[items_of(c) for c in fields])).alias("x"))
        .filter(F.col("x.item") != "")
        .groupBy("x.field", "x.item").count()
    )
    total = F.sum("count").alias("total")
    totals = counted.groupBy("field").agg(total)
    least = F.greatest(F.lit(min_count), F.ceil(F.col("total") * min_share))
    rows = counted.join(F.broadcast(totals), "field").filter(F.col("count") >= least).select("field", "item", "count", least.alias("least")).collect()
    out: dict[str, list[str]] = {c: [] for c in fields}
    for col in fields:
        mine = [r for r in rows if r["field"] == col]
        _, shape, _ = FIELDS.get(col, (SOFT_CATEGORY, None, never_longer))
        if shape is not None:
            out[col] = sorted(r["item"] for r in mine if shape(r["item"]))
            continue
        soft = re.compile(SOFT_CATEGORY)
        known = {r["item"] for r in mine if not soft.search(r["item"])}
        for r in sorted(mine, key=lambda r: (len(r["item"]), r["item"])):
            parts = [p.strip() for p in soft.split(r["item"])]
            if len(parts) > 1 and not all(p in known or not p for p in parts):
                # a mix of known and unknown parts is a list, unless it is as common as a value is
                if not any(p in known for p in parts) or r["count"] >= 4 * r["least"]:
                    known.add(r["item"])
        out[col] = sorted(known)
    return out


def segment_udf(fields: dict[str, Sequence[str]]):
    """Arrow-batched `(field, value) -> array<string>`; one automaton a field is built per Python worker call."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        covers = {c: Segmenter(FIELDS[c][0], known, FIELDS[c][1], FIELDS[c][2]) for c, known in fields.items()}
        for names, values in batches:
            yield pd.Series([covers[c].split(v) for c, v in zip(names, values)], dtype=object)

    return run.asNondeterministic()


_MAYBE_PACKED = r"[;,|/&\t\n\r•·]|\S\s+\S"


def split_listing_fields(df: DataFrame, id_col: str = "listing_id", min_share: float = 1e-4) -> DataFrame:
    """The packed fields of the listing table, one row per value of every field holding two or more:
    id, field_name, pos (from 1), val.

    Null and blank fields, and fields with one value, give no rows. Repeated values keep their
    own positions. No shuffle but that of the dictionary's counts; a value of any length or number of
    pieces is treated alike.
    """
    names = list(FIELDS)
    split = segment_udf(count_dictionaries(df, names, min_share))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").alias("v")) for c in names])).alias("x")
    return (
        df.select(F.col(f"`{id_col}`").alias(id_col), each)
        .filter(F.col("x.v").rlike(_MAYBE_PACKED))
        .select(id_col, F.col("x.f").alias("field_name"), split("x.f", "x.v").alias("vals"))
        .filter(F.size("vals") >= 2)
        .select(id_col, "field_name", F.posexplode("vals").alias("pos", "val"))
        .select(id_col, "field_name", (F.col("pos") + 1).cast("long").alias("pos"), "val")
    )
