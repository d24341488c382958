"""Small scalar expressions: keys, lists in one field, sizes, durations, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITIONS = 32
#: Values that stand for nothing in sheets (fixed values).
SHEET_BLANKS = ("nan", "none", "null", "-")
_UNITS = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}


def partition_key(link: Column, partitions: int = PARTITIONS) -> Column:
    """Deterministic hash partition: the first 8 hex digits of the MD5, modulo `partitions`."""
    return F.pmod(F.conv(F.substring(F.md5(link), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def first_filled(*cols: Column) -> Column:
    """First column that is not blank, trimmed; '' when all are."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def split_list(c: Column, separator: str = ";") -> Column:
    """Trimmed items of a separated field without blanks; null gives an empty array."""
    items = F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def join_list(c: Column, separator: str = "; ") -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), separator)


def merge_arrays(old: Column, new: Column) -> Column:
    """Union in order of appearance without nulls and empty strings."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.filter(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)), lambda x: x.isNotNull() & (x != ""))
    )


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def round_as_decimal(c: Column, digits: int) -> Column:
    """Half-up rounding of the exact decimal, as SQL numerics round."""
    return F.round(c.cast("decimal(28,10)"), digits).cast("double")


def formula_guard(c: Column) -> Column:
    """Prefix with an apostrophe what a sheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def sheet_value(c: Column) -> Column:
    """'' for null and for placeholders of sheets."""
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*SHEET_BLANKS), "").otherwise(c)


def strip_processed(c: Column) -> Column:
    return F.regexp_replace(c, "_processed$", "")


def parse_size(text: str) -> int:
    """Bytes of '10', '1k', '3mb', '1g'."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in _UNITS or int(m[1]) == 0:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def duration_text(seconds: Column) -> Column:
    """'1h 02m 03s', '2m 03s' or '3.0s'."""
    h, m, s = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), F.floor(seconds % 60)
    return (
        F.when(seconds >= 3600, F.format_string("%dh %02dm %02ds", h, m, s))
        .when(seconds >= 60, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%.1fs", seconds.cast("double")))
    )


def eta_text(minutes: Column) -> Column:
    """'N/A', '<1min', '12min' or '2h05m'."""
    return (
        F.when(minutes.isNull(), "N/A")
        .when(minutes < 1, "<1min")
        .when(minutes < 60, F.format_string("%.0fmin", minutes.cast("double")))
        .otherwise(F.format_string("%dh%02dm", F.floor(minutes / 60), F.floor(minutes % 60)))
    )


def session_id(server: Column, ts: Column) -> Column:
    return F.concat_ws("_", server, F.date_format(ts, "yyyyMMdd_HHmmss"))


def country_code(c: Column, default: str = "XX") -> Column:
    """First two letters in upper case, `default` for null."""
    return F.upper(F.substring(F.coalesce(c, F.lit(default)), 1, 2))


def chunk_rows(workers: int, file_mb: float, ram_gb: float) -> int:
    """Rows per chunk of a file, 0 when it fits into memory whole.

    What is left of the memory beside 500 MB for the system and 300 MB a worker counts to 70 %; chunks
    aim at 50 MB, at most a quarter of that, of rows of 5 KB, within 1000 and 100 000 rows.
    """
    spare = (ram_gb * 1024 - 500 - workers * 300) * 0.7
    if file_mb <= spare:
        return 0
    return max(1000, min(100_000, int(min(50, spare / 4) * 1024 / 5)))
