"""Readers: listing files of both models, many files at once, the JSON source table, lines, bytes, folders."""

from __future__ import annotations

import codecs
import re
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.functions.common import blank_to_null
from contactweave.operators.postprocess import url_column, useful_columns

#: Encodings tried one after the other (fixed values).
TRIAL_ENCODINGS = (
    "utf-8", "shift_jis", "euc-jp", "iso-2022-jp", "euc-kr", "cp949", "gb2312", "gbk", "gb18030", "big5",
    "cp1252", "cp1251", "cp1250", "iso-8859-1", "iso-8859-15", "utf-16", "utf-16-le", "utf-16-be",
)
#: Those of two bytes a letter; Western text with single accented letters decodes under them too.
_WIDE = frozenset(TRIAL_ENCODINGS[1:10])
_TOUCHING = re.compile(r"[A-Za-z][\u2e80-\uffef]|[\u2e80-\uffef][A-Za-z]")
_IDEOGRAPH = re.compile(r"[\u2e80-\uffef]")
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


#: Charsets that the CSV source takes without further permission.
_SPARK_CHARSETS = frozenset(("utf-8", "iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32"))
#: Bytes at the head of a file that tell its encoding.
SAMPLE = 100_000


def file_encodings(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Encoding of each file by its first `SAMPLE` bytes; files that can't be read are left out. One row a file."""

    @F.pandas_udf("string")
    def guess(head: pd.Series) -> pd.Series:
        def one(raw) -> str:
            # the cut may fall into a letter, so a few bytes at the end don't count
            raw = bytes(raw)
            return guess_encoding(raw if len(raw) < SAMPLE else raw[: raw.rfind(b"\n") + 1] or raw[:-4])

        return head.map(one)

    found: dict[str, str] = {}
    for path in paths:
        try:
            files = spark.read.format("binaryFile").load(path).select("path", guess(F.substring("content", 1, SAMPLE)).alias("e"))
            found |= {path: r["e"] for r in files.collect()}
        except Exception:  # noqa: BLE001 - a missing file is reported by the caller
            continue
    return found


def read_listing(spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, all_columns: bool = False, broken_lines: bool = True) -> DataFrame:
    """Listing CSV, every column a string (phones keep their plus), only useful columns, rows without a web address dropped.

    `source_file` is the file's name. Without `encoding` each file's own is looked up; a file that can't be opened is left out
    with a warning. `broken_lines` allows line breaks in quotes, which makes each file one task; without it
    large files are split.
    """
    many = [paths] if isinstance(paths, str) else list(paths)
    kinds = {p: encoding for p in many} if encoding else file_encodings(spark, many)
    for p in many:
        if p not in kinds:
            warnings.warn(f"{p} can't be read and is left out", stacklevel=2)
    if not kinds:
        raise FileNotFoundError(f"none of {many} can be read")
    if not {k.lower() for k in kinds.values()} <= _SPARK_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the other encodings of Java's CSV reader
    parts = []
    for kind in dict.fromkeys(kinds.values()):
        mine = [p for p in kinds if kinds[p] == kind]
        for p in mine:  # files may differ in their columns
            parts.append(spark.read.csv(p, header=True, inferSchema=False, multiLine=broken_lines, escape='"', encoding=kind).withColumn("source_file", F.col("_metadata.file_name")))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in df.columns if c != "source_file"]
    df = df.select(*(names if all_columns else useful_columns(names)), "source_file").na.fill("")
    url = url_column(df.columns)
    return df.filter(F.trim(url) != "") if url else df


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def count_with_url(df: DataFrame, limit: int | None = None) -> int:
    """Rows with a web address; with `limit`, counting ends there."""
    url = url_column(df.columns)
    rows = df.filter(F.trim(url) != "")
    return (rows.limit(limit) if limit else rows).count()


def is_readable_csv(spark: SparkSession, path: str) -> bool:
    """The file opens under one of the trial encodings and holds a row."""
    try:
        kind = file_encodings(spark, [path]).get(path)
        return kind is not None and not spark.read.csv(path, header=True, mode="PERMISSIVE", encoding=kind).isEmpty()
    except Exception:  # noqa: BLE001 - any failure to open means it isn't readable
        return False


def parsable(df: DataFrame, col: str = "data") -> DataFrame:
    """Rows whose JSON parses as a whole: one value and nothing behind it.

    The parsers stop after the first value; as the only element of an array, anything behind it
    breaks the array or makes it longer.
    """
    whole = F.json_array_length(F.concat(F.lit("["), F.col(col), F.lit("]"))) == 1
    return df.filter(F.try_parse_json(col).isNotNull() & whole)


RESULT_FIELDS = {
    "link": "string", "web_site": "string", "title": "string", "phone": "string", "category": "string", "address": "string", "latitude": "double",
    "longtitude": "double", "longitude": "double", "review_count": "int", "review_rating": "double", "domain": "string", "cid": "string",
    "data_id": "string", "price_range": "string", "claimed": "string", "timezone": "string", "plus_code": "string",
    "thumbnail": "string", "featured_image": "string",
}


def parse_results(results: DataFrame) -> DataFrame:
    """Rows of the JSON source table with a link and a web site; others and unparsable ones are dropped.

    The misspelt longitude wins over the right one; the country is its first two letters in upper
    case, XX without one.
    """
    schema = ", ".join(f"{k} {t}" for k, t in RESULT_FIELDS.items())
    schema += ", complete_address struct<borough:string,street:string,city:string,postal_code:string,state:string,country:string>"
    j = F.from_json("data", schema)
    d = parsable(results).select("id", j.alias("d"))
    return d.select(
        F.col("id").alias("result_id"),
        blank_to_null(F.col("d.link")).alias("link"),
        blank_to_null(F.col("d.web_site")).alias("url"),
        *[F.trim(F.col(f"d.{c}")).alias(c) for c in ("title", "phone", "category", "address", "domain", "cid", "data_id", "price_range", "timezone", "claimed", "plus_code", "thumbnail", "featured_image")],
        F.col("d.latitude").alias("latitude"),
        F.coalesce(F.nullif(F.col("d.longtitude"), F.lit(0.0)), F.col("d.longitude")).alias("longitude"),
        F.col("d.review_count").alias("review_count"),
        F.col("d.review_rating").alias("review_rating"),
        F.coalesce(F.upper(F.substring(blank_to_null(F.col("d.complete_address.country")), 1, 2)), F.lit("XX")).alias("country"),
        *[F.trim(F.col(f"d.complete_address.{c}")).alias(c) for c in ("borough", "street", "city", "postal_code", "state")],
    ).filter(F.col("link").isNotNull() & F.col("url").isNotNull())


def read_lines(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """Lines without blanks and # comments, trimmed; `distinct` as a set."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return lines.distinct() if distinct else lines


def parse_endpoints(lines: DataFrame) -> DataFrame:
    """server, protocol, username, password of lines like host:port, host:port:user:pass, proto://user:pass@host:port."""
    x = F.col("line")
    url = r"^(?:(\w+)://)?(?:([^:@/]+):([^@/]+)@)?([^:@/]+):(\d{1,5})$"
    four = r"^([^:@/]+):(\d{1,5}):([^:]+):(.+)$"
    is_four = x.rlike(four) & ~x.contains("@")
    part = lambda p, i: F.regexp_extract(x, p, i)
    null = lambda c: F.nullif(c, F.lit(""))
    host, port = F.when(is_four, part(four, 1)).otherwise(part(url, 4)), F.when(is_four, part(four, 2)).otherwise(part(url, 5))
    return lines.select(
        "line",
        F.concat_ws(":", host, port).alias("server"),
        F.coalesce(F.when(~is_four, null(part(url, 1))), F.lit("http")).alias("protocol"),
        null(F.when(is_four, part(four, 3)).otherwise(part(url, 2))).alias("username"),
        null(F.when(is_four, part(four, 4)).otherwise(part(url, 3))).alias("password"),
    ).filter((host != "") & port.cast("int").between(1, 65535))


def valid_ip_port(c):
    """host:port with octets up to 255 (or a host name) and a port of 1 to 65535."""
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    ip = rf"^(?:{octet}\.){{3}}{octet}:"
    port = F.regexp_extract(c, r":(\d{1,5})$", 1).cast("int")
    return F.coalesce((c.rlike(ip) | c.rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9][A-Za-z0-9.\-]*:")) & port.between(1, 65535), F.lit(False))


def _fits(raw: bytes, name: str) -> bool:
    """The bytes decode, nothing is replaced, and ideographs don't stand inside Latin words."""
    try:
        text = raw.decode(name)
    except (LookupError, UnicodeDecodeError):
        return False
    if "�" in text:
        return False
    if name in _WIDE:
        signs = len(_IDEOGRAPH.findall(text))
        return not signs or len(_TOUCHING.findall(text)) <= 0.3 * signs
    return name == "utf-8" or not name.startswith("utf-16") or text.isprintable()


def guess_encoding(raw: bytes, declared: str | None = None) -> str:
    """Byte order mark, declared charset, charset in the first 4 KB, then the first encoding that fits."""
    for mark, name in _BOMS:
        if raw.startswith(mark):
            return name
    head = raw[:4096].decode("latin-1")
    m = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", head, re.I) or re.search(r"<\?xml[^>]*encoding=[\"']([\w\-]+)", head)
    for name in (declared, m[1] if m else None):
        if name:
            try:
                if "�" not in raw.decode(name):
                    return name.lower()
            except (LookupError, UnicodeDecodeError):
                continue
    return next((name for name in TRIAL_ENCODINGS if _fits(raw, name)), "latin-1")


def decode_bytes(raw: bytes | None, declared: str | None = None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    name = guess_encoding(raw, declared)
    return raw.decode(name, errors="surrogateescape" if name == "utf-8" else "replace"), name


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_DECODED)
def decode_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, declared in batches:
        yield pd.DataFrame([decode_bytes(None if r is None else bytes(r), d) for r, d in zip(raw, declared)], columns=["text", "encoding"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files as decoded text: path, text, encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_udf("content", F.lit(None).cast("string")).alias("d")).select("path", "d.text", "d.encoding")


def unprocessed(files: DataFrame, processed: DataFrame, suffix: str = "_processed") -> DataFrame:
    """Input files without a processed one of the same stem; both hold a column `name`."""
    stem = lambda c: F.regexp_replace(c, r"\.csv$", "")
    done = processed.select(F.regexp_replace(stem(F.col("name")), f"{suffix}$", "").alias("__stem")).distinct()
    return files.withColumn("__stem", stem(F.col("name"))).join(done, "__stem", "left_anti").drop("__stem")


def read_marker(spark: SparkSession, path: str) -> dict | None:
    """Figures of a completion marker, None without one."""
    try:
        rows = spark.read.json(path).limit(1).collect()
    except Exception:  # noqa: BLE001 - a missing or broken marker means not completed
        return None
    return rows[0].asDict() if rows else None


def single_url(spark: SparkSession, url: str) -> DataFrame:
    return spark.createDataFrame([(url,)], "url string")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_there(spark: SparkSession, path: str) -> bool:
    """A table of files at `path` can be read."""
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception:  # noqa: BLE001 - any failure to open means there is none
        return False


def read_table(spark: SparkSession, where: str, name: str, key: str = "id", tasks: int = 32) -> DataFrame:
    """A table by its parquet path or, with a jdbc: address, from a database.

    A database table is read by `tasks` queries over ranges of `key`; filters and columns reach the database.
    """
    if not where.startswith("jdbc:"):
        return spark.read.parquet(where)
    source = spark.read.format("jdbc").option("url", where)
    edge = source.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").load().first()
    ranges = source.option("dbtable", name)
    if edge["low"] is None:
        return ranges.load()
    return ranges.option("partitionColumn", key).option("lowerBound", edge["low"]).option("upperBound", edge["high"]).option("numPartitions", tasks).load()
