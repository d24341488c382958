"""Letter folding shared by the matchers: case, accents and the letters that carry no accent mark."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that canonical decomposition leaves alone (fixed values).
SPECIAL = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ğ": "g", "Ğ": "G", "đ": "d", "Đ": "D",
    "ß": "ss", "ẞ": "SS", "ı": "i", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
}


class _Folding(dict):
    """Code point to folded text, filled as letters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFD", SPECIAL.get(c, c))
        folded = self[code] = "".join(x for x in plain if not unicodedata.combining(x)).casefold()
        return folded


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Lower case without accents; ASCII passes through at C speed, other text in one translation."""
    return text.lower() if text.isascii() else text.translate(_FOLDING)


def damerau(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance in a band of `limit`; limit + 1 when it is larger."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    big = limit + 1
    before: list[int] = []
    prev = [j if j <= limit else big for j in range(lb + 1)]
    for i in range(1, la + 1):
        cur = [big] * (lb + 1)
        if i <= limit:
            cur[0] = i
        lo, hi = max(1, i - limit), min(lb, i + limit)
        ca = a[i - 1]
        least = cur[0]
        for j in range(lo, hi + 1):
            cb = b[j - 1]
            d = prev[j - 1] if ca == cb else 1 + min(prev[j - 1], prev[j], cur[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            cur[j] = d if d < big else big
            if cur[j] < least:
                least = cur[j]
        if least > limit:
            return big
        before, prev = prev, cur
    return prev[lb]


def folded(text: Column) -> Column:
    """`fold` as a column expression for Latin letters; other scripts are lower-cased only."""
    letters = [chr(o) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for o in range(a, b)]
    plain = {c: fold(c) for c in letters}
    for c, f in plain.items():
        if len(f) > 1:
            text = F.replace(text, F.lit(c), F.lit(f))
    one = [(c, f) for c, f in plain.items() if len(f) == 1 and f != c]
    return F.lower(F.translate(text, "".join(c for c, _ in one), "".join(f for _, f in one)))
