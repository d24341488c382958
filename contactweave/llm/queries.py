"""Queries of the operators tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.llm import encoding_repair, leak_search, org_names, places, reference_match, residue, stuffing, tokenizing
from contactweave.plans.registry import Registry
from contactweave.session import table

R = Registry()

# The same in SQL where it stays practical over whole tables (run by DuckDB).
_PAIRS = {"ø": "o", "ł": "l", "ħ": "h", "ğ": "g", "đ": "d", "ı": "i", "ð": "d"}


def _folded(c: str) -> str:
    for a, b in (("ß", "ss"), ("ẞ", "ss"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"), ("þ", "th"), ("Þ", "th")):
        c = f"replace({c}, '{a}', '{b}')"
    low, plain = "".join(_PAIRS), "".join(_PAIRS.values())
    return f"lower(strip_accents(translate({c}, '{low}ØŁĦĞĐÐ', '{plain}olhgdd')))"


def _runs(key: str, source: str, span: int) -> str:
    """Distinct runs of `span` folded words per key."""
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + {span - 1}], ' ') AS run FROM
 (SELECT {key}, regexp_extract_all({_folded('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE text <> '') x, unnest(range(1, len(w) - {span - 2})) u(i))"""


LEAK_SQL = f"""SELECT DISTINCT doc_id, item_id FROM {_runs('doc_id', 'documents', leak_search.SPAN)} d JOIN {_runs('item_id', 'benchmark', leak_search.SPAN)} b USING (run)"""

_S = stuffing
STUFFED_SQL = f"""WITH t AS (SELECT md5(text) AS key, any_value(text) AS text, min(lang) AS lang FROM documents WHERE length(text) > 0 GROUP BY 1),
 w AS (SELECT key, lang, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: CASE WHEN regexp_full_match(x, '\\p{{N}}+') THEN '#' ELSE x END) AS ws FROM t),
 z AS (SELECT lang, count(*) AS n FROM t WHERE lang IS NOT NULL GROUP BY 1),
 m AS (SELECT lang, word, -ln(count(*) / n) AS s FROM (SELECT DISTINCT key, lang, unnest(ws) AS word FROM w WHERE lang IS NOT NULL) JOIN z USING (lang)
  GROUP BY lang, word, n HAVING count(*) >= 2 AND count(*) >= {_S.MIN_SHARE} * n),
 tf AS (SELECT key, word, count(*) AS f FROM (SELECT key, unnest(ws) AS word FROM w) GROUP BY 1, 2),
 r AS (SELECT key, ln(f) AS y, ln(row_number() OVER (PARTITION BY key ORDER BY f DESC, word)) AS x, f FROM tf),
 c AS (SELECT key, count(*) / sum(f) AS extent, coalesce(regr_slope(y, x), 0) AS slope,
  coalesce(sqrt(greatest(regr_syy(y, x) * (1 - coalesce(regr_r2(y, x), 1)), 0) / count(*)), 0) AS residual FROM r GROUP BY 1),
 g AS (SELECT key, l.lang, sum(f * least(coalesce(s, {_S.FLOOR}), {_S.FLOOR})) / sum(f) AS divergence,
  sum(CASE WHEN coalesce(s, {_S.FLOOR}) < -ln({_S.FUNCTION_SHARE}) THEN f ELSE 0 END) / sum(f) AS share
  FROM tf CROSS JOIN (SELECT DISTINCT lang FROM m) l LEFT JOIN m ON m.word = tf.word AND m.lang = l.lang GROUP BY 1, 2),
 b AS (SELECT key, min(divergence) AS divergence, arg_min(share, divergence) AS share FROM g GROUP BY 1)
 SELECT doc_id FROM documents JOIN (SELECT key FROM c JOIN b USING (key) WHERE divergence >= {_S.MAX_DIVERGENCE} AND (slope <= {_S.MIN_SLOPE} OR residual >= {_S.MAX_RESIDUAL}
  OR extent + {_S.FUNCTION_WEIGHT} * share + {_S.SLOPE_WEIGHT} * greatest(slope, -1) < {_S.MIN_EVENNESS})) h ON md5(text) = h.key WHERE length(text) > 0"""


@R.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = table(spark, sf_dir, "country_ref")
    towns = reference_match.map_towns(table(spark, sf_dir, "results"), table(spark, sf_dir, "city_ref"), countries)
    codes = reference_match.map_countries(table(spark, sf_dir, "zen_contacts"), countries)
    return towns.select(F.lit("results").alias("src_table"), "rec_id", "ref_key").unionByName(
        codes.select(F.lit("zen_contacts").alias("src_table"), "rec_id", "ref_key")
    )


@R.add("p3_candidates")
def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within the distance of each typed town, with their distances."""
    return reference_match.town_candidates(table(spark, sf_dir, "results"), table(spark, sf_dir, "city_ref"), table(spark, sf_dir, "country_ref"))


@R.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, sf_dir, "sample_input"), "listing_id", ("name", "street")).select(
        "listing_id", "field_name"
    )


@R.add("p7_restored")
def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = encoding_repair.repaired(table(spark, sf_dir, "sample_input"), "listing_id", ("name", "street"))
    return fixed.select("listing_id", "field_name", "value", "restored", F.array_join("layers", "; ").alias("layers"), "lost")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = places.listing_records(table(spark, sf_dir, "sample_input")).unionByName(
        places.result_records(table(spark, sf_dir, "results"))
    )
    return places.match_places(records, table(spark, sf_dir, "city_ref"), table(spark, sf_dir, "country_ref"))


@R.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.class_pairs(_placed(spark, sf_dir), "rec_id", "place")


@R.add("p6_places")
def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has a place: the smallest id there and the number of other records."""
    return places.class_members(_placed(spark, sf_dir), "rec_id", "place")


def _organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org_names.organisations(
        table(spark, sf_dir, "sample_input"), table(spark, sf_dir, "city_ref"), table(spark, sf_dir, "country_ref")
    )


@R.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.class_pairs(_organisations(spark, sf_dir), "listing_id", "org", "name")


@R.add("p4_classes")
def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listing that has an organisation: the smallest id there and the number of listings under another spelling."""
    return places.class_members(_organisations(spark, sf_dir), "listing_id", "org", "name")


@R.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, sf_dir, "documents"))


@R.add("p8_texts", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return tokenizing.decode_corpus(tokenizing.encode_corpus(table(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("text_md5"))


@R.add("p9_found", LEAK_SQL)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.add("p10_found", STUFFED_SQL)
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_documents(table(spark, sf_dir, "documents"))


@R.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "pages")).select("page_id")
