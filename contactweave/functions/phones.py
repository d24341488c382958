"""Phone numbers by calling code and national length for a stated set of regions.

There is no numbering-plan metadata here: a number of a region outside the table is `unknown`, and
the kind (mobile or fixed) is told by leading digits only where the region gives them away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Region: calling code, shortest and longest national number, leading digits of mobiles (fixed values).
REGIONS = {
    "MT": ("356", 8, 8, "[79]"), "DE": ("49", 6, 11, "1[5-7]"), "FR": ("33", 9, 9, "[67]"), "ES": ("34", 9, 9, "[67]"), "GB": ("44", 9, 10, "7"),
    "IT": ("39", 6, 11, "3"), "AT": ("43", 5, 13, "6"), "CH": ("41", 9, 9, "7[5-9]"), "NL": ("31", 9, 9, "6"), "BE": ("32", 8, 9, "4[5-9]"),
    "PT": ("351", 9, 9, "9"), "IE": ("353", 7, 9, "8"), "DK": ("45", 8, 8, ""), "SE": ("46", 7, 10, "7"), "NO": ("47", 8, 8, "[49]"),
    "FI": ("358", 5, 12, "[45]"), "PL": ("48", 9, 9, "[5-8]"), "CZ": ("420", 9, 9, "[67]"), "SK": ("421", 9, 9, "9"), "SI": ("386", 8, 8, "[3-7][01]"),
    "HU": ("36", 8, 9, "[2357]0"), "RO": ("40", 9, 9, "7"), "BG": ("359", 7, 9, "[89]8"), "GR": ("30", 10, 10, "69"), "HR": ("385", 8, 9, "9"),
    "CY": ("357", 8, 8, "9"), "EE": ("372", 7, 8, "5"), "LV": ("371", 8, 8, "2"), "LT": ("370", 8, 8, "6"), "LU": ("352", 5, 11, "6"),
    "IS": ("354", 7, 9, "[678]"), "TR": ("90", 10, 10, "5"), "US": ("1", 10, 10, ""), "SG": ("65", 8, 8, "[89]"), "IN": ("91", 10, 10, "[6-9]"),
    "BR": ("55", 10, 11, "..9"), "MX": ("52", 10, 10, ""), "AU": ("61", 9, 9, "4"), "ID": ("62", 8, 12, "8"), "AE": ("971", 8, 9, "5"), "ZA": ("27", 9, 9, "[678]"),
    "JP": ("81", 9, 10, "[789]0"), "KR": ("82", 8, 10, "1"), "CN": ("86", 10, 11, "1[3-9]"), "RU": ("7", 10, 10, "9"), "UA": ("380", 9, 9, "[5-9]"),
}
_BY_CODE = sorted(((c, r) for r, (c, *_x) in REGIONS.items()), key=lambda x: -len(x[0]))


def parse(raw: str | None, region: str | None = None) -> tuple[str, str, str, str]:
    """(E.164, region, kind, reason) of a typed number; kind is mobile, fixed_line, toll_free or unknown.

    `reason` is valid, empty_number, no_country, unknown_region or invalid_format.
    """
    if raw is None or not raw.strip():
        return "", "", "unknown", "empty_number"
    s = re.sub(r"(?i)(?:ext|x)\.?\s*\d+\s*$", "", raw.strip())
    s = re.sub(r"\(0\)", "", s)
    plus = s.lstrip("( ").startswith("+") or s.startswith("00")
    digits = re.sub(r"\D", "", s)
    if s.startswith("00"):
        digits = digits[2:]
    national, home = digits, region
    if plus:
        home = next((r for c, r in _BY_CODE if digits.startswith(c)), None)
        if home is None:
            return "+" + digits, "", "unknown", "unknown_region"
        national = digits[len(REGIONS[home][0]) :]
    elif region is None:
        return digits, "", "unknown", "no_country"
    elif region not in REGIONS:
        return digits, region, "unknown", "unknown_region"
    code, low, high, mobile = REGIONS[home]
    if not plus and home != "IT":
        national = national.lstrip("0")
    if not low <= len(national) <= high:
        return "+" + code + national, home, "unknown", "invalid_format"
    kind = "toll_free" if national.startswith("800") else "mobile" if not mobile or re.match(mobile, national) else "fixed_line"
    return "+" + code + national, home, kind, "valid"


PHONE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("e164", "region", "kind", "reason")])


@F.pandas_udf(PHONE_TYPE)
def normalize_phone(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """`(raw, region) -> struct`, Arrow-batched."""
    for raw, region in batches:
        yield pd.DataFrame([parse(a, b) for a, b in zip(raw, region)], columns=PHONE_TYPE.names)


WHATSAPP_TYPE = T.StructType(
    [T.StructField("valid", T.BooleanType())] + [T.StructField(n, T.StringType()) for n in ("formatted", "country", "type", "reason")]
)


def check_whatsapp(raw: str | None, region: str | None = None) -> tuple[bool, str, str, str, str]:
    """Valid when the number is a valid mobile one."""
    e164, home, kind, reason = parse(raw, region)
    if reason != "valid":
        return False, (raw or "").strip(), "", "unknown", reason
    return kind == "mobile", e164, home, kind, "valid" if kind == "mobile" else "not_mobile"


@F.pandas_udf(WHATSAPP_TYPE)
def validate_whatsapp(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, region in batches:
        yield pd.DataFrame([check_whatsapp(a, b) for a, b in zip(raw, region)], columns=WHATSAPP_TYPE.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_phones(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`(numbers, region) -> numbers`: E.164 where a number is valid, else as it was; distinct, in order."""
    for numbers, regions in batches:
        out = []
        for values, region in zip(numbers, regions):
            got = (parse(v, region) for v in (values if values is not None else ()))
            out.append(list(dict.fromkeys(g[0] if g[3] == "valid" else v for g, v in zip(got, values if values is not None else ()))))
        yield pd.Series(out, dtype=object)


CHECKED_TYPE = T.ArrayType(
    T.StructType([T.StructField("number", T.StringType()), T.StructField("valid", T.BooleanType())] + [T.StructField(n, T.StringType()) for n in ("type", "country", "reason")])
)


@F.pandas_udf(CHECKED_TYPE)
def check_whatsapps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`(numbers, region) -> array<struct<number, valid, type, country, reason>>` of the distinct numbers that aren't blank."""
    for numbers, regions in batches:
        out = []
        for values, region in zip(numbers, regions):
            distinct = dict.fromkeys(v.strip() for v in (values if values is not None else ()) if v and v.strip())
            rows = []
            for v in distinct:
                ok, _formatted, country, kind, reason = check_whatsapp(v, region)
                rows.append({"number": v, "valid": ok, "type": kind, "country": country, "reason": reason})
            out.append(rows)
        yield pd.Series(out, dtype=object)
