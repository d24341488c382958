"""Queries of the two loading operators: records that fail to parse, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.operators import packed, quarantine
from contactweave.plans.registry import Registry
from contactweave.session import table

R = Registry()

_F = """(?:"[^"]*(?:""[^"]*)*"|[^",]*)"""
_FORM = f"""
 SELECT line_id, raw_line,
        regexp_full_match(raw_line, '{_F}(?:,{_F})*', 's') AS clean,
        length(regexp_replace(raw_line, '"[^"]*"', '', 'g'))
          - length(replace(regexp_replace(raw_line, '"[^"]*"', '', 'g'), ',', '')) + 1 AS n
 FROM listing_lines"""


def _field(i: int) -> str:
    return (
        f"""regexp_replace(replace(regexp_extract(raw_line, '^(?:{_F},){{{i}}}({_F})', 1, 's'), '""', '"'), '^"|"$', '', 'g')"""
    )


_TYPED = f"""
 SELECT *, trim({_field(5)}) AS u, trim({_field(6)}) AS p FROM ({_FORM}) WHERE clean AND n = 11"""
_HOST = """regexp_replace(regexp_extract(u, '^(?:(?i:https?:)?//)?([^/?#]*)', 1), ':[0-9]{1,5}$', '')"""
_URL_OK = f"""(NOT contains(u, '@') AND regexp_matches({_HOST},
  '^[^\\s:.,<>"'']+(?:\\.[^\\s:.,<>"'']+)*\\.[^\\s:.,<>"''0-9][^\\s:.,<>"'']+\\.?$'))"""
_PHONE = r"regexp_replace(p, '(?i)\s*ext\.?\s*[0-9]+$', '')"
_PHONE_OK = f"""(regexp_full_match({_PHONE}, '[0-9 +()\\-./]+')
  AND length(regexp_replace({_PHONE}, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)"""


@R.add(
    "p1_found",
    f"""WITH form AS ({_FORM}), typed AS ({_TYPED})
 SELECT line_id, CASE WHEN NOT clean THEN 'quoting' ELSE 'column_count' END AS reason
 FROM form WHERE NOT clean OR n <> 11
 UNION ALL SELECT line_id, 'url' FROM typed WHERE u <> '' AND NOT {_URL_OK}
 UNION ALL SELECT line_id, 'phone_number' FROM typed WHERE p <> '' AND NOT {_PHONE_OK}""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.rejects(quarantine.error_parse(table(spark, sf_dir, "listing_lines")))


_ALL = ", ".join(f"{_field(i)} AS {n}" for i, n in enumerate(quarantine.LISTING_HEADER))


@R.add(
    "p1_loaded",
    f"""WITH typed AS ({_TYPED})
 SELECT line_id, {_ALL} FROM typed WHERE (u = '' OR {_URL_OK}) AND (p = '' OR {_PHONE_OK})""",
)
def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.loaded(quarantine.error_parse(table(spark, sf_dir, "listing_lines")))


@R.add("p1_edits")
def p1_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits of every record that breaks the form: number of quote and delimiter repairs, and the operations in order."""
    parsed = quarantine.error_parse(table(spark, sf_dir, "listing_lines"))
    broken = (F.col("parse.quote_edits") > 0) | (F.col("parse.delimiter_edits") > 0)
    return parsed.filter(broken).select("line_id", "parse.quote_edits", "parse.delimiter_edits", F.array_join("parse.edits", "; ").alias("edits"))


@R.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_listing_fields(table(spark, sf_dir, "sample_input"))
