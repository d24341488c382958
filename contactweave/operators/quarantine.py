"""Rows that fail to parse: minimum-cost error parse of delimited records (problem 1).

A record is parsed against the grammar of a delimited file. The error parse is a dynamic
program over (quote state, fields closed so far) whose arcs either read the record as it
stands (cost 0) or insert / delete a quote or a delimiter. Costs are ordered: fewest quote
repairs first, then fewest delimiter repairs. A record of cost 0 whose typed fields are
valid is loaded; otherwise the repairs on the cheapest path and the failed types state the
reasons.

The cost-0 layer of that program is a regular language, so it is evaluated as a possessive
(linear time) regular expression inside whole-stage codegen. Only records that this layer
rejects go on to the layers of cost > 0, which run Arrow-batched in Python. There is no
shuffle: at any scale the operator is one narrow pass over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header of the listing CSV (fixed values).
LISTING_HEADER = (
    "No", "name", "street", "city", "country_code", "url", "phone_number", "email",
    "google_business_categories", "facebook", "instagram",
)

#: One field that needs no repair; unrolled and possessive, so long fields cost no stack.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"

EDIT_KINDS = ("insert_quote", "delete_quote", "split_after_quote", "insert_delimiter", "delete_delimiter")


def web_address_ok(c: Column) -> Column:
    """Scheme http/https, `//` or none; host with a dot between labels, no space and no `@`."""
    t = F.trim(c)
    host = F.regexp_extract(t, r"^(?:(?i:https?:)?//)?([^/?#]*)", 1)
    host = F.regexp_replace(host, r":\d{1,5}$", "")
    return (
        ~t.contains("@")
        & host.rlike(r"^[^\s:.,<>\"']+(?:\.[^\s:.,<>\"']+)*\.[^\s:.,<>\"'\d][^\s:.,<>\"']+\.?$")
    )


def phone_ok(c: Column) -> Column:
    """7 to 15 digits, beside them only spaces and `+ ( ) - . /`; an extension's digits don't count."""
    t = F.trim(c)
    main = F.regexp_replace(t, r"(?i)\s*ext\.?\s*\d+$", "")
    digits = F.length(F.regexp_replace(main, r"[^0-9]", ""))
    return main.rlike(r"^[0-9 +()\-./]+$") & digits.between(7, 15)


#: Validators of the listing CSV by column name; a blank value is never a failure.
LISTING_TYPES = {"url": web_address_ok, "phone_number": phone_ok}


def repair(line: str, columns: int) -> tuple[int, int, list[str]]:
    """Cheapest repair of one record: (quote repairs, delimiter repairs, the operations in order).

    States: 0 field start, 1 unquoted, 2 inside quotes, 3 just after a quote that closed a
    field. The record is cut into tokens (quote, delimiter, run of other characters), so the
    work is tokens x 4 x columns and stays linear in the length of the record.
    """
    tokens = re.findall(r'"|,|[^",]+', line)
    # best[(state, fields)] = (quote repairs, delimiter repairs, trail); trail is a linked list.
    best: dict[tuple[int, int], tuple[int, int, tuple | None]] = {(0, 1): (0, 0, None)}
    for at, tok in enumerate(tokens):
        nxt: dict[tuple[int, int], tuple[int, int, tuple | None]] = {}

        def offer(key: tuple[int, int], q: int, d: int, trail: tuple | None) -> None:
            old = nxt.get(key)
            if old is None or (q, d) < old[:2]:
                nxt[key] = (q, d, trail)

        for (state, n), (q, d, trail) in best.items():
            if tok == '"':
                if state == 0:
                    offer((2, n), q, d, trail)
                elif state == 1:
                    offer((1, n), q + 1, d, ("delete_quote", at, trail))
                elif state == 2:
                    offer((3, n), q, d, trail)
                else:
                    offer((2, n), q, d, trail)  # the second half of a doubled quote
                if state in (0, 2, 3):
                    offer((state, n), q + 1, d, ("delete_quote", at, trail))
            elif tok == ",":
                if state == 2:
                    offer((2, n), q, d, trail)
                    if n < columns:
                        offer((0, n + 1), q + 1, d, ("insert_quote", at, trail))
                else:
                    if n < columns:
                        offer((0, n + 1), q, d, trail)
                    # the next field's quotes still follow the grammar when its delimiter goes
                    offer((0, n), q, d + 1, ("delete_delimiter", at, trail))
                    offer((state, n), q, d + 1, ("delete_delimiter", at, trail))
            else:
                if state in (0, 1):
                    offer((1, n), q, d, trail)
                    if state == 0:
                        offer((2, n), q + 1, d, ("insert_quote", at, trail))
                elif state == 2:
                    offer((2, n), q, d, trail)
                else:  # text after a closing quote: reopen the field, or start a new one
                    offer((2, n), q + 1, d, ("insert_quote", at, trail))
                    if n < columns:
                        offer((1, n + 1), q + 1, d, ("split_after_quote", at, trail))
        best = nxt
    done: tuple[int, int, tuple | None] | None = None
    for (state, n), (q, d, trail) in best.items():
        if state == 2:
            q, trail = q + 1, ("insert_quote", len(tokens), trail)
        missing = columns - n
        for _ in range(missing):
            trail = ("insert_delimiter", len(tokens), trail)
        if done is None or (q, d + missing) < done[:2]:
            done = (q, d + missing, trail)
    quotes, delims, trail = done
    ops: list[str] = []
    while trail is not None:
        ops.append(f"{trail[0]}@{trail[1]}")
        trail = trail[2]
    return quotes, delims, ops[::-1]


_REPAIR_TYPE = T.StructType(
    [
        T.StructField("quote_edits", T.IntegerType()),
        T.StructField("delimiter_edits", T.IntegerType()),
        T.StructField("edits", T.ArrayType(T.StringType())),
    ]
)


def _repair_udf(columns: int):
    @F.pandas_udf(_REPAIR_TYPE)
    def run(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in lines:
            yield pd.DataFrame(
                [repair(x, columns) if x is not None else (None, None, None) for x in s],
                columns=["quote_edits", "delimiter_edits", "edits"],
            )

    # Not deterministic for the optimizer: a filter on the result must not evaluate it twice.
    return run.asNondeterministic()


def error_parse(
    df: DataFrame,
    line_col: str = "raw_line",
    header: Sequence[str] = LISTING_HEADER,
    types: dict | None = None,
) -> DataFrame:
    """`df` with one struct column `parse`: fields, edits, quote_edits, delimiter_edits, reasons, loaded.

    Null records: no fields, reason `null_record`, not loaded. An empty record is one empty
    field, hence `column_count`. Existing columns are kept; only `parse` is replaced.
    """
    types = LISTING_TYPES if types is None else types
    columns = len(header)
    line = F.col(f"`{line_col}`")
    raw = F.regexp_extract_all(line, F.lit(rf"(?:\A|,)({_FIELD})"), F.lit(1))
    fields = F.transform(
        raw,
        lambda x: F.when(
            x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(x),
    )
    work = df.withColumn("__clean", F.coalesce(line.rlike(_RECORD), F.lit(False)))
    work = work.withColumn("__raw", F.when(F.col("__clean"), fields))
    work = work.withColumn("__form", F.col("__clean") & (F.size("__raw") == columns))
    # Only records beyond cost 0 are sent to Python: the others pass a null through Arrow.
    work = work.withColumn("__fix", _repair_udf(columns)(F.when(~F.col("__form"), line)))
    type_reasons = [
        F.when(
            F.col("__form")
            & (F.trim(F.get("__raw", F.lit(list(header).index(name)))) != "")
            & ~check(F.get("__raw", F.lit(list(header).index(name)))),
            F.lit(name),
        )
        for name, check in types.items()
    ]
    form_reason = (
        F.when(line.isNull(), F.lit("null_record"))
        .when(F.col("__fix.quote_edits") > 0, F.lit("quoting"))
        .when(F.col("__fix.delimiter_edits") > 0, F.lit("column_count"))
    )
    reasons = F.filter(F.array(form_reason, *type_reasons), lambda x: x.isNotNull())
    work = work.withColumn("__reasons", reasons)
    parse = F.struct(
        F.when(F.col("__form"), F.col("__raw")).alias("fields"),
        F.coalesce(F.col("__fix.edits"), F.array().cast("array<string>")).alias("edits"),
        F.coalesce(F.col("__fix.quote_edits"), F.lit(0)).alias("quote_edits"),
        F.coalesce(F.col("__fix.delimiter_edits"), F.lit(0)).alias("delimiter_edits"),
        F.col("__reasons").alias("reasons"),
        (F.size("__reasons") == 0).alias("loaded"),
    )
    return work.withColumn("parse", parse).drop("__clean", "__raw", "__form", "__fix", "__reasons")


def rejects(parsed: DataFrame, keep: Sequence[str] = ("line_id",)) -> DataFrame:
    """One row per record and reason, for the quarantine table."""
    return parsed.filter(~F.col("parse.loaded")).select(
        *keep, F.explode("parse.reasons").alias("reason")
    )


def loaded(parsed: DataFrame, keep: Sequence[str] = ("line_id",), header: Sequence[str] = LISTING_HEADER) -> DataFrame:
    """The valid records as typed columns; all fields stay strings, as phones keep their plus sign."""
    return parsed.filter(F.col("parse.loaded")).select(
        *keep, *[F.get("parse.fields", F.lit(i)).alias(name) for i, name in enumerate(header)]
    )
