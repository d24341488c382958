"""Encoding of the whole corpus with a public tokenizer: global distinct-word shuffle (problem 8).

Byte-level BPE never merges across pre-tokens, so each distinct pre-token is encoded once for the
whole corpus. Texts are cut into pre-tokens in the JVM (regular expression), the distinct ones are counted and
encoded Arrow-batched, and the ids are joined back and put together by position. Decoding joins the table
of token bytes.

Words follow Zipf's law, so a plain join on the word would send a tenth of the corpus to one task.
Words with at least `hot_share` of all occurrences, of which there can be no more than
1 / hot_share, are looked up where the text is; that is the bound under which their ids are shipped. What is left of a
text are its runs of known ids and the gaps between them: only the words of the gaps are sent to their ids and back, with
all their places in a text at once. A row is a row throughout, so no repeated text is a key, and a text without gaps
and rows with an empty or null text take no part in any join.

The tokenizer's file is a parameter; nothing is trained and nothing is copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.components import ensure_checkpoint_dir

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Pre-token pattern of the byte-level vocabularies (fixed value), white space as in Unicode.
_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str):
    import tiktoken

    # Pre-tokens come in ready-made: the pattern takes each as a whole.
    return tiktoken.Encoding("corpus", pat_str=r"(?s).+", mergeable_ranks=load_ranks(path), special_tokens={})


def encode_udf(path: str):
    """`pre-token -> ids`; the vocabulary is read from `path` on the executors, once per task."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path)
        for s in batches:
            yield s.map(enc.encode_ordinary)

    return run.asNondeterministic()


def decode_corpus(encoded: DataFrame, path: str = f"{TOKENIZER_DIR}/{BYTE_BPE_50K}", id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids): joins the table of token bytes, at most one row per vocabulary entry.

    Rows need distinct ids; an empty list gives an empty text. Bytes that are no UTF-8 are replaced.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for b, i in load_ranks(path).items()], "token int, bytes binary")
    parts = encoded.select(id_col, F.posexplode("ids").alias("pos", "token")).join(F.broadcast(table), "token")
    texts = parts.groupBy(id_col).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda x: x["h"]), ""
        ).alias("h")
    )
    return encoded.select(id_col).join(texts, id_col, "left").select(
        id_col, F.coalesce(F.decode(F.unhex("h"), "UTF-8"), F.lit("")).alias("text")
    )


_PARTS = T.StructType(
    [T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("gaps", T.ArrayType(T.StringType()))]
)


def _known_udf(shared):
    """`pre-tokens -> (runs, gaps)`: ids of known words, cut where a word has to be asked for; one more run than gaps."""

    @F.pandas_udf(_PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for s in batches:
            rows = []
            for words in s:
                runs, gaps, ids = [], [], []
                for piece, word in zip(map(known.get, words), words):
                    if piece is None:
                        runs.append(ids)
                        gaps.append(word)
                        ids = []
                    else:
                        ids += piece
                runs.append(ids)
                rows.append((runs, gaps))
            yield pd.DataFrame(rows, columns=_PARTS.names)

    return run.asNondeterministic()


def encode_corpus(
    documents: DataFrame,
    path: str = f"{TOKENIZER_DIR}/{BYTE_BPE_50K}",
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_share: float = 1e-5,
) -> DataFrame:
    """(id, ids) for every row; a null and an empty text give an empty list.

    Special tokens' strings are ordinary text. Rows with equal texts, equal ids or null ids keep
    their own row each.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    docs = documents.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    counted = docs.filter(F.length("text") > 0).select(F.explode(cut).alias("word")).groupBy("word").count()
    words = counted.select("word", encode_udf(path)("word").alias("piece"), "count").checkpoint()
    least = (words.agg(F.sum("count")).first()[0] or 0) * hot_share
    hot = words.filter(F.col("count") >= least).select("word", "piece").limit(int(1 / hot_share) + 1).collect()
    shared = spark.sparkContext.broadcast({r["word"]: list(r["piece"]) for r in hot})
    cold = words.filter(F.col("count") < least).select("word", "piece")
    parts = docs.filter(F.length("text") > 0).select(id_col, F.monotonically_increasing_id().alias("row"), _known_udf(shared)(cut).alias("p")).select(id_col, "row", "p.*").checkpoint()
    gapped = parts.filter(F.size("gaps") > 0)
    asked = gapped.select("row", F.posexplode("gaps").alias("at", "word")).groupBy("row", "word").agg(F.collect_list("at").alias("places"))
    answered = (
        asked.join(cold, "word").select("row", F.explode("places").alias("at"), "piece").groupBy("row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]).alias("late"))
    )
    late = F.transform("runs", lambda ids, i: F.concat(ids, F.coalesce(F.get("late", i), F.array().cast("array<int>"))))
    none = F.array().cast("array<int>")
    return (
        gapped.join(answered, "row").select(id_col, F.flatten(late).alias("ids"))
        .unionByName(parts.filter(F.size("gaps") == 0).select(id_col, F.flatten("runs").alias("ids")))
        .unionByName(docs.filter((F.length("text") == 0) | F.col("text").isNull()).select(id_col, none.alias("ids")))
    )
