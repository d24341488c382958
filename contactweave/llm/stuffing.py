"""Keyword-stuffed and link-list pages: rank-frequency curves against same-language prose (problem 10).

Per page, SQL windows rank its words by frequency and a line is fitted to ln f over ln r: its slope,
the residual around it and its extent (ranks per word, 1 when no word repeats). The page's language
is the one whose prose it diverges from least; the divergence is the mean surprise of its words,
-ln of the share of that language's distinct texts that hold the word, with one floor for rare
words. A page is flagged by itself when its curve is far too steep for its length or far from a
line. A page that diverges from prose is flagged when its curve is too steep, too far from a line,
or when extent, share of the language's function words and slope together stay below what prose of
any length has: prose repeats function words, so short pages have a high extent and long ones many
function words, while stuffed pages have neither.
Divergence alone flags nothing, as prose on a rare subject diverges as much.

The word model is counted over prose only (`prose_like`), repeated texts counting once, so that neither
copies of one page nor variants of one keyword list can become the norm; every text is then judged
by it. Texts are cut into words once, whole: ranking and fitting need no shuffle beyond that by text key, and what
is kept of a text are its curve and the hashes and counts of its words, from which function words, word model and
divergence follow. The word model keeps words held by at least `min_share` of a language's texts,
which bounds it by (mean distinct words) / `min_share`; it is broadcast only below `max_model` rows
and joined by a shuffle beyond.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactweave.llm.components import ensure_checkpoint_dir

MIN_SHARE = 0.002
FLOOR = -math.log(0.001)
#: A word held by this share of a language's texts is a function word of its prose.
FUNCTION_SHARE = 0.2
MAX_DIVERGENCE = 2.2
#: Evenness: extent + FUNCTION_WEIGHT * function_share + SLOPE_WEIGHT * slope; prose of any length has more.
MIN_EVENNESS = 0.7
FUNCTION_WEIGHT = 0.9
SLOPE_WEIGHT = 0.5
MIN_SLOPE = -0.85
MAX_RESIDUAL = 0.45
#: Curves that flag by themselves, from so many words on (prose of few set phrases comes to -0.89 and 0.44); beyond
#: LONG words prose steepens by SLOPE_DRIFT per ln of length.
ALONE_SLOPE = -1.0
ALONE_RESIDUAL = 0.55
ALONE_WORDS = 32
LONG = 400
SLOPE_DRIFT = 0.08
#: Share of the most varied texts of a language and band of doubling length, which show what its prose is like.
VARIED_SHARE = 0.25
MIN_HELD = 0.5
MAX_MODEL = 500_000
#: Languages that get a column each; more of them are summed as rows.
MAX_LANGUAGES = 40


def _words(text: Column) -> Column:
    """Hashes of the lower-case words; every number is the same word. Nothing below asks for a word's letters."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    # plain letters need no test
    return F.transform(raw, lambda w: F.xxhash64(F.when(((w < "a") | (w >= "{")) & w.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(w)))


def word_curves(documents: DataFrame) -> DataFrame:
    """Per distinct text: key, lang, its curve (n, types, slope, residual), and its words as hashes with their counts."""
    texts = (
        documents.filter(F.length("text") > 0)
        .select(F.unhex(F.md5("text")).alias("key"), "lang", "text")
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.min("lang").alias("lang"))
    )
    tf = texts.select("key", "lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("key", "lang", "word").agg(F.count("*").cast("int").alias("f"))
    ranked = tf.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("f"), "word")))
    y, x = F.log("f"), F.log("r")
    return ranked.groupBy("key").agg(
        F.first("lang").alias("lang"),
        F.sum("f").alias("n"),
        F.count("*").alias("types"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(
            F.sqrt(F.greatest(F.regr_syy(y, x) * (1 - F.coalesce(F.regr_r2(y, x), F.lit(1.0))), F.lit(0.0)) / F.count("*")), F.lit(0.0)
        ).alias("residual"),
        F.collect_list("word").alias("words"),
        F.collect_list("f").alias("counts"),
    )


def word_model(curves: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(word, surprise: map<lang, double>) from the distinct texts of a known language; words are hashes."""
    known = curves.filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("texts"))
    held = known.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
    return (
        held.join(F.broadcast(sizes), "lang")
        .filter((F.col("count") >= 2) & (F.col("count") >= min_share * F.col("texts")))
        .groupBy("word")
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", -F.log(F.col("count") / F.col("texts"))))).alias("surprise"))
    )


def prose_like(curves: DataFrame) -> DataFrame:
    """The distinct texts (rows of `curves`) of a known language that vary their words as its prose does.

    Texts are compared with those of their language and length. The most varied quarter shows the
    language's function words; prose has at least `MIN_HELD` times as many different ones a word as that
    quarter's median. A list of keywords has few, in whatever number its variants come, as long as a
    quarter of a length band isn't made of the most varied lists.
    """
    heads = curves.filter(F.col("lang").isNotNull()).withColumn("band", F.floor(F.log2("n"))).withColumn("extent", F.col("types") / F.col("n"))
    least = heads.groupBy("lang", "band").agg(F.percentile_approx("extent", 1 - VARIED_SHARE, 1000).alias("least")).checkpoint()
    varied = heads.join(F.broadcast(least), ["lang", "band"]).filter("extent >= least")
    sizes = varied.groupBy("lang").agg(F.count("*").alias("texts"))
    function_words = (
        varied.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
        .join(F.broadcast(sizes), "lang")
        .filter(F.col("count") > FUNCTION_SHARE * F.col("texts"))
        .groupBy("lang").agg(F.collect_set("word").alias("function_words"))
    ).checkpoint()
    with_held = lambda df: df.join(F.broadcast(function_words), "lang", "left").withColumn(
        "held", F.coalesce(F.size(F.array_intersect("words", "function_words")), F.lit(0)) / F.col("n")
    )
    usual = with_held(varied).groupBy("lang", "band").agg(F.percentile_approx("held", 0.5, 1000).alias("usual")).checkpoint()
    return with_held(heads).join(F.broadcast(usual), ["lang", "band"]).filter(F.col("held") >= MIN_HELD * F.col("usual")).select(*curves.columns)


def page_features(documents: DataFrame, max_columns: int = MAX_LANGUAGES) -> DataFrame:
    """Per distinct text: key, n, types, slope, residual, extent, language, divergence, function_share."""
    ensure_checkpoint_dir(documents.sparkSession)
    curves = word_curves(documents).checkpoint()
    model = word_model(prose_like(curves)).checkpoint()
    found = model.select(F.explode(F.map_keys("surprise")).alias("l")).distinct().limit(max_columns + 1).collect()
    small = model.count() <= MAX_MODEL
    shape = ["key", "n", "types", "slope", "residual"]
    tf = curves.select("key", "n", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    floor = F.lit(FLOOR)
    none = F.struct(floor.alias("divergence"), F.lit(0.0).alias("share"), F.lit(None).cast("string").alias("language"))
    if len(found) <= max_columns:
        # a column of the model per language: nothing is multiplied
        languages = sorted(r["l"] for r in found)
        wide = model.select("word", *[F.least(F.coalesce(F.element_at("surprise", F.lit(lang)), floor), floor).alias(f"m{i}") for i, lang in enumerate(languages)])
        sums = []
        for i in range(len(languages)):
            s = F.coalesce(f"m{i}", floor)
            sums += [F.sum(F.col("f") * s).alias(f"s{i}"), F.sum(F.when(F.col(f"m{i}") < -math.log(FUNCTION_SHARE), F.col("f")).otherwise(0)).alias(f"h{i}")]
        spent = tf.join(F.broadcast(wide) if small else wide, "word", "left").groupBy("key").agg(F.count("*").alias("words"), *sums)
        per = curves.select(*shape).join(spent.drop("words"), "key")
        fits = [
            F.struct((F.col(f"s{i}") / F.col("n")).alias("divergence"), (F.col(f"h{i}") / F.col("n")).alias("share"), F.lit(lang).alias("language"))
            for i, lang in enumerate(languages)
        ]
        best = reduce(lambda a, b: F.when(b["divergence"] < a["divergence"], b).otherwise(a), fits, none)
    else:
        # any number of languages: a row per word and language that holds it; what a word of the model saves is summed
        long = model.select("word", F.explode("surprise").alias("lang", "m"))
        saved = (
            tf.join(F.broadcast(long) if small else long, "word").groupBy("key", "lang")
            .agg(F.sum(F.col("f") * (floor - F.least("m", floor))).alias("saved"), F.sum(F.when(F.col("m") < -math.log(FUNCTION_SHARE), F.col("f")).otherwise(0)).alias("held"))
            .filter("saved > 0").groupBy("key").agg(F.max_by(F.struct("saved", "held", "lang"), F.struct("saved", "lang")).alias("top"))
        )
        per = curves.select(*shape).join(saved, "key", "left")
        best = F.when(
            F.col("top").isNotNull(),
            F.struct((floor - F.col("top.saved") / F.col("n")).alias("divergence"), (F.col("top.held") / F.col("n")).alias("share"), F.col("top.lang").alias("language")),
        ).otherwise(none)
    return per.withColumn("best", best).select(
        "key", "n", "types", "slope", "residual", (F.col("types") / F.col("n")).alias("extent"),
        F.col("best.language").alias("language"), F.col("best.divergence").alias("divergence"), F.col("best.share").alias("function_share"),
    )


def flagged(features: DataFrame) -> DataFrame:
    """`features` with the boolean column `stuffed`."""
    curve = (
        (F.col("slope") <= MIN_SLOPE)
        | (F.col("residual") >= MAX_RESIDUAL)
        | (F.col("extent") + FUNCTION_WEIGHT * F.col("function_share") + SLOPE_WEIGHT * F.greatest("slope", F.lit(-1.0)) < MIN_EVENNESS)
    )
    steep = F.col("slope") <= ALONE_SLOPE - SLOPE_DRIFT * F.greatest(F.log(F.col("n") / LONG), F.lit(0.0))
    alone = (F.col("n") >= ALONE_WORDS) & (steep | (F.col("residual") >= ALONE_RESIDUAL))
    return features.withColumn("stuffed", alone | ((F.col("divergence") >= MAX_DIVERGENCE) & curve))


def stuffed_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every page that consists mostly of keywords, links, menus or tags.

    Null, empty and wordless texts are no case. Every copy of a flagged text is reported.
    """
    hits = flagged(page_features(documents)).filter("stuffed").select("key")
    return (
        documents.filter(F.length("text") > 0)
        .select("doc_id", F.unhex(F.md5("text")).alias("key"))
        .join(hits, "key", "left_semi")
        .select("doc_id")
    )
