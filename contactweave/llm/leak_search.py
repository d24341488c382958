"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search (problem 9).

The patterns are all runs of `span` successive words of the evaluation items, over folded words
(case, accents, punctuation and white space don't count). The search slides a window of `span`
words over a document. Its last block of two words is looked up in the shift table: a block that
occurs in no pattern lets the window jump span - 1 words, a block that occurs earlier in some
pattern jumps to align it. Where the shift is zero, the bucket of the block (the suffix hash)
gives the candidate patterns, and word by word comparison confirms them.

The tables are built once on the driver from up to `max_items` items and shipped as a broadcast, which
every worker process keeps. Longer lists are cut into blocks of that size by the item's hash, and each block is
searched for by itself, so a list has no upper bound. Documents pass Arrow-batched, once per block,
without a shuffle, and are read to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.folding import fold
from contactweave.session import bounded_rows

SPAN = 10
MAX_ITEMS = 20_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Folded words: unbroken runs of letters and digits."""
    return _WORD.findall(fold(text))


class WuManber:
    """Shift and bucket tables over blocks of two words of all patterns of `span` words."""

    def __init__(self, items: Sequence[tuple[int, str]], span: int = SPAN):
        if span < 2:
            raise ValueError("a pattern needs at least two words")
        self.span = span
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[tuple[str, ...], list[int]]]] = {}
        patterns: dict[tuple[str, ...], set[int]] = {}
        for item, text in items:
            w = words(text) if text else []
            for i in range(len(w) - span + 1):
                patterns.setdefault(tuple(w[i : i + span]), set()).add(item)
        for p, owners in patterns.items():
            for end in range(1, span):
                block = (p[end - 1], p[end])
                jump = span - 1 - end
                if jump < self.shift.get(block, span - 1):
                    self.shift[block] = jump
            self.bucket.setdefault((p[-2], p[-1]), []).append((p, sorted(owners)))

    def find(self, text: str | None) -> list[int]:
        """Ids of the items of which the text holds at least `span` successive words, ascending."""
        if not text:
            return []
        w = words(text)
        span, shift, full = self.span, self.shift, self.span - 1
        found: set[int] = set()
        end = full
        n = len(w)
        while end < n:
            jump = shift.get((w[end - 1], w[end]), full)
            if jump:
                end += jump
                continue
            start = end - full
            for p, owners in self.bucket[(w[end - 1], w[end])]:
                if w[start] == p[0] and tuple(w[start : end + 1]) == p:
                    found.update(owners)
            end += 1
        return sorted(found)


_kept: dict[int, WuManber] = {}


def _search_for(shared, key: int) -> WuManber:
    """The tables of a broadcast, kept by this worker process."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = WuManber(*shared.value)
    return _kept[key]


def leaks(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id): every document with every item it gives away.

    Null, empty and short texts hold nothing; items of fewer than `span` words have no pattern.
    A repeated document is reported under each of its ids.
    """
    sc = documents.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND length(text) > 0")
    blocks = max(1, -(-items.count() // max_items))

    def block(i: int) -> DataFrame:
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else items
        # a block holds about max_items rows; the factor allows for the hash, the check for ids that repeat
        rows = bounded_rows(mine, 4 * max_items, "evaluation items of a block")
        shared = sc.broadcast(([(r["item_id"], r["text"]) for r in rows], span))
        key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            search = _search_for(shared, key)
            for s in texts:
                yield s.map(search.find)

        hits = run.asNondeterministic()(F.col("text"))
        return documents.filter(F.length("text") > 0).select("doc_id", hits.alias("items")).select("doc_id", F.explode("items").alias("item_id"))

    return reduce(lambda a, b: a.unionByName(b), [block(i) for i in range(blocks)])
