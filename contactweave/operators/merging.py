"""Set-like writes: merge by key, insert what is missing, keep the first, union of files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactweave.functions.common import merge_arrays, partition_key
from contactweave.session import AS_OF, ensure_checkpoint_dir

ARRAYS = ("emails", "phones", "whatsapp")
SOCIALS = ("social_facebook", "social_instagram", "social_tiktok", "social_youtube")
OVERWRITTEN = ("scrape_final_url", "scrape_was_redirected", "scrape_status", "scrape_error", "scrape_time_seconds", "scrape_pages_count", "last_scrape_server")


#: Names of the countries that contacts are shown with (fixed values).
COUNTRY_NAMES = {
    "US": "United States", "GB": "United Kingdom", "CA": "Canada", "AU": "Australia", "DE": "Germany", "FR": "France", "IT": "Italy", "ES": "Spain", "JP": "Japan", "KR": "South Korea", "CN": "China",
    "IN": "India", "BR": "Brazil", "MX": "Mexico", "ID": "Indonesia", "SG": "Singapore", "MY": "Malaysia", "TH": "Thailand", "VN": "Vietnam", "PH": "Philippines", "NL": "Netherlands", "BE": "Belgium",
    "CH": "Switzerland", "AT": "Austria", "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "FI": "Finland", "PL": "Poland", "CZ": "Czech Republic", "RU": "Russia", "UA": "Ukraine", "TR": "Turkey",
    "SA": "Saudi Arabia", "AE": "UAE", "ZA": "South Africa", "EG": "Egypt", "NG": "Nigeria", "KE": "Kenya", "NZ": "New Zealand", "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "PE": "Peru",
    "PT": "Portugal", "IE": "Ireland", "IL": "Israel",
}


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by `order`: aggregated partially before the shuffle, no window."""
    rest = [c for c in df.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(key).agg(top).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def _order_of(df: DataFrame) -> list[str]:
    """Columns that tell which of several rows of one link is the later one."""
    return [c for c in ("last_scrape_at", "updated_at", "id") if c in df.columns] or [c for c in df.columns if not dict(df.dtypes)[c].startswith("map")]


def upsert(old: DataFrame, new: DataFrame, as_of: str = AS_OF, clean: bool = True) -> DataFrame:
    """Merged contact rows by `source_link` with every column of `old`.

    Arrays are united (`clean` drops nulls and ''), counts and `has_` flags recomputed, socials kept
    unless the new row has one, scrape columns overwritten, `scrape_count` raised. Any other column
    keeps the value of `old`; a link that `old` lacks comes in whole, columns that `new` lacks being
    null. Rows of `old` alone stay as they are. Of several rows of one link in `new`, the latest counts
    (last_scrape_at, updated_at, id). Null links are left out of `new`.
    """
    key = "source_link"
    new = latest_per_key(new.filter(F.col(key).isNotNull()), key, _order_of(new))
    kinds = dict(old.dtypes)
    names = [c for c in old.columns if c != key]
    n = new.select(key, *[(F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(kinds[c])).alias(f"n_{c}") for c in names], F.lit(True).alias("n_here"))
    j = old.withColumn("o_here", F.lit(True)).join(n, key, "full_outer")
    fresh, there = F.col("n_here").isNotNull(), F.col("o_here").isNotNull()
    none = F.array().cast("array<string>")
    united = lambda c: merge_arrays(F.col(c), F.col(f"n_{c}")) if clean else F.array_distinct(
        F.concat(F.coalesce(c, none), F.coalesce(f"n_{c}", none))
    )
    size = lambda c: F.when(fresh, F.size(united(c))).otherwise(F.coalesce(F.size(c), F.lit(0)))
    flags = {"has_email": "emails", "has_phone": "phones", "has_whatsapp": "whatsapp"}
    values = {c: F.when(there, F.col(c)).otherwise(F.col(f"n_{c}")) for c in names}
    values |= {c: F.when(fresh, united(c)).otherwise(F.col(c)) for c in ARRAYS}
    values |= {f"{c}_count": size(c) for c in ARRAYS}
    values |= {f: size(c) > 0 for f, c in flags.items() if f in names}
    values |= {c: F.coalesce(f"n_{c}", c) for c in SOCIALS}
    values |= {c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN}
    values["scrape_count"] = (F.coalesce("scrape_count", F.lit(0)) + F.when(fresh, 1).otherwise(0)).cast("int")
    values |= {c: F.when(fresh, F.lit(as_of).cast(kinds[c])).otherwise(F.col(c)) for c in ("updated_at", "last_scrape_at") if c in names}
    values["partition_key"] = partition_key(F.col(key))
    order = [key, *dict.fromkeys([*names, "partition_key", *(f"{c}_count" for c in ARRAYS)])]
    return j.select(*[F.col(key) if c == key else values[c].alias(c) for c in order])


def fold_generations(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per `source_link` as if its rows had been merged one after the other by `order`.

    Arrays are united in that order, socials take the last one given, scrape columns the last row's,
    `scrape_count` grows by one per later row, every other column is the first row's. Scalars are reduced
    before the shuffle; array items pass as distinct (link, item), so a hot link collects distinct items only.
    """
    key = "source_link"
    rows = rows.filter(F.col(key).isNotNull())
    at = F.struct(*order)
    special = {*ARRAYS, *SOCIALS, *OVERWRITTEN, *(f"{c}_count" for c in ARRAYS), "scrape_count", key}
    rest = [c for c in rows.columns if c not in special]
    base = rows.groupBy(key).agg(
        F.min_by(F.struct(*rest), at).alias("__f"), F.max_by(F.struct(*OVERWRITTEN), at).alias("__l"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in SOCIALS],
        (F.coalesce(F.min_by("scrape_count", at), F.lit(0)) + F.count("*") - 1).cast("int").alias("scrape_count"),
    )
    none = F.array().cast("array<string>")

    def placed(c: str) -> Column:
        return F.transform(F.coalesce(c, none), lambda x, i: F.struct(F.lit(c).alias("kind"), x.alias("item"), i.alias("pos")))

    items = F.concat(*[placed(c) for c in ARRAYS])
    firsts = (
        rows.select(key, at.alias("__at"), F.explode(items).alias("x")).filter(F.coalesce(F.col("x.item"), F.lit("")) != "")
        .groupBy(key, "x.kind", "x.item").agg(F.min(F.struct("__at", "x.pos")).alias("__first"))
    )
    lists = firsts.groupBy(key).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("__first", "item")))), lambda x: x["item"]).alias(c) for c in ARRAYS
    ])
    j = base.join(lists, key, "left")
    out = {c: F.col(f"__f.{c}") for c in rest} | {c: F.coalesce(c, none) for c in ARRAYS} | {f"{c}_count": F.coalesce(F.size(c), F.lit(0)) for c in ARRAYS}
    out |= {c: F.col(c) for c in (*SOCIALS, "scrape_count", key)} | {c: F.col(f"__l.{c}") for c in OVERWRITTEN}
    return j.select(*[out[c].alias(c) for c in rows.columns])


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`target` and the rows of `source` whose key it lacks; nothing is updated."""
    new = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by `order`; null is a key value of its own.

    The whole row travels as a struct through min_by, so a hot key is reduced before the shuffle.
    """
    names = df.columns
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("__r")
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(first).select(*[F.col(f"__r.{c}").alias(c) for c in names])


def dedupe_columns(columns: Sequence[str]) -> list[str]:
    """Columns that tell rows apart: name and address, else one of them with url, else url."""
    names = [c for c in columns if c.lower() in ("name", "business_name", "company_name", "company", "business")]
    places = [c for c in columns if c.lower() in ("address", "street", "location", "street_address", "full_address")]
    url = ["url"] if "url" in columns else []
    if names and places:
        return [names[0], places[0]]
    return [*(names or places)[:1], *url] if names or places else url


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All columns of all parts; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_common(parts: Sequence[DataFrame]) -> DataFrame:
    """Only the columns that every part has, in the first part's order."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*common) for p in parts])


def even_split(df: DataFrame, parts: int, order: Sequence[str]) -> DataFrame:
    """`part` from 1: sizes differ by one at most, the first parts are the longer ones.

    Row numbers come from offsets of written range partitions, not from one global window task.
    """
    numbered = row_numbers(df, order)
    n = numbered.agg(F.count("*").alias("__n"))
    base, extra = F.floor(F.col("__n") / parts), F.col("__n") % parts
    edge = extra * (base + 1)
    part = F.when(F.col("rn") <= edge, F.floor((F.col("rn") - 1) / (base + 1))).otherwise(extra + F.floor((F.col("rn") - 1 - edge) / F.greatest(base, F.lit(1))))
    return numbered.join(F.broadcast(n)).withColumn("part", (part + 1).cast("long")).drop("__n")


def fixed_split(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """`part` from 1 with at most `rows` rows each."""
    return row_numbers(df, order).withColumn("part", (F.floor((F.col("rn") - 1) / rows) + 1).cast("long"))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Rows with their global number by `order`, ties in the order of the input.

    The rows are ranged, sorted and written once (checkpoint() in the session's folder), so that their
    partitions can't change any more; the place in its partition then is a row's number but for the
    partition's offset, of which there is one row a partition. The input's place joins the order, hence
    a key that a third of all rows share is spread over partitions too. No window, no second shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.withColumn("__i", F.monotonically_increasing_id())
    by = [*[F.col(f"`{c}`") for c in order], F.col("__i")]
    written = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("__i").withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__m", 33)
    sizes = written.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return written.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, local + F.col("__o") + 1).drop("__p", "__m", "__o")


def round_robin(jobs: DataFrame, order: Sequence[str], endpoints: DataFrame, key: str) -> DataFrame:
    """`jobs` with `turn` (from 0, by `order`) and the endpoint whose turn it is; without endpoints `key` is null.

    The endpoints are numbered by name; their list is joined by its number, so neither side is collected.
    """
    numbered = row_numbers(endpoints.select(key).distinct(), [key], "slot").withColumn("slot", F.col("slot") - 1)
    n = numbered.count()
    turns = row_numbers(jobs, order, "turn").withColumn("turn", F.col("turn") - 1)
    return turns.withColumn("slot", F.pmod("turn", F.lit(n)) if n else F.lit(None).cast("long")).join(numbered, "slot", "left").drop("slot")


def still_usable(endpoints: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Endpoints that have not failed; all of them when every one has."""
    left = endpoints.join(failed.select(key).distinct(), key, "left_anti")
    return endpoints if left.isEmpty() else left


def prepared_contacts(rows: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Rows for the contact table from listing records of the JSON source and what enrichment found.

    `rows` holds the columns of `readers.parse_results` and, where enriched, `emails`, `phones`, `whatsapp` (arrays or
    lists joined by ';'), `facebook` .. `youtube`, `final_url`, `was_redirected`, `scraping_status`, `scraping_error`,
    `processing_time`, `pages_scraped`, `server_id`. A column that is missing takes its default; rows without a link are dropped.
    """
    kinds = dict(rows.dtypes)
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in kinds else F.lit(d)
    maybe = lambda c, t="string": F.nullif(F.col(c).cast("string"), F.lit("")).cast(t) if c in kinds else F.lit(None).cast(t)
    none = F.array().cast("array<string>")

    def items(c: str) -> Column:
        if c not in kinds:
            return none
        a = F.col(c) if kinds[c].startswith("array") else F.split(F.col(c), ";")
        return F.coalesce(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), none)

    filled = lambda *cs: F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cs], F.lit(""))
    country = F.upper(F.trim(text("country")))
    named = F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair])
    values = {
        "source_link": filled("link", "url"), "country_code": F.when(country.rlike("^[A-Z]{2}$"), country).otherwise("XX"),
        "business_name": filled("name", "title"), "business_category": text("category"), "business_website": filled("url", "domain"),
        **{c: text(c) for c in ("city", "state", "borough", "street", "address", "postal_code", "timezone")},
        "latitude": maybe("latitude", "double"), "longitude": maybe("longitude", "double"),
        "gmaps_phone": text("phone"), "gmaps_rating": maybe("review_rating", "double"), "gmaps_review_count": maybe("review_count", "int"), "gmaps_cid": text("cid"), "gmaps_data_id": text("data_id"),
        "gmaps_price_range": text("price_range"), "gmaps_status": text("claimed"), "gmaps_domain": text("domain"), "gmaps_plus_code": text("plus_code"), "gmaps_thumbnail": text("thumbnail"),
        "gmaps_featured_image": text("featured_image"), "source_id": maybe("result_id", "long"),
        **{c: items(c) for c in ARRAYS}, **{f"{c}_count": F.size(items(c)) for c in ARRAYS}, **{f"social_{p}": maybe(p) for p in ("facebook", "instagram", "tiktok", "youtube")},
        "scrape_final_url": filled("final_url", "url"), "scrape_was_redirected": F.lower(text("was_redirected")).isin("true", "1", "yes"), "scrape_status": filled("status", "scraping_status"),
        "scrape_error": filled("error", "scraping_error"), "scrape_time_seconds": F.coalesce(maybe("processing_time", "double"), F.lit(0.0)), "scrape_pages_count": F.coalesce(maybe("pages_scraped", "int"), F.lit(0)),
        "last_scrape_server": text("server_id", "unknown"), "scrape_count": F.lit(1), "last_scrape_at": F.lit(as_of).cast("timestamp_ntz"),
    }
    out = rows.select(*[v.alias(c) for c, v in values.items()]).filter(F.col("source_link") != "")
    return out.withColumn("partition_key", partition_key(F.col("source_link"))).withColumn("country_name", F.coalesce(F.element_at(named, F.col("country_code")), F.lit(""))).withColumn(
        "scrape_status", F.when(F.col("scrape_status") == "", "unknown").otherwise(F.col("scrape_status"))
    )
