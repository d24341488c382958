"""Pigeonhole segment join: all pairs of strings of a block within a length-dependent distance.

A string of length L that allows k edits is cut into k + 1 segments; whatever k edits do, one
segment survives. The shorter string of a pair is indexed by its segments, the longer one looks
up the substrings at the positions where a segment can be the first or the last to survive (the edits
left of it and right of it bound its shift), and every candidate pair is verified with the banded
Levenshtein distance of the JVM. Both sides are sets of distinct
strings per block, so a string repeated in a third of all rows is one node, and the join key holds
block, length, segment number and segment, so that even one huge block spreads over all tasks.
No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (shortest length, edits allowed), longest first; below the last length only equal strings match.
LADDER = ((14, 3), (8, 2), (5, 1))


def edits(length: Column, ladder=LADDER) -> Column:
    """Edits allowed for the shorter string of a pair."""
    c = F.lit(0)
    for least, k in reversed(ladder):
        c = F.when(length >= least, F.lit(k)).otherwise(c)
    return c


def _allowed(n: int, ladder) -> int:
    return next((k for least, k in ladder if n >= least), 0)


def _cuts(n: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the k + 1 segments; the last ones are longer by one where it doesn't divide."""
    base, extra = divmod(n, k + 1)
    out, start = [], 0
    for i in range(k + 1):
        size = base + (k + 1 - i <= extra)
        out.append((start, size))
        start += size
    return out


def index_keys(text: str, ladder=LADDER) -> list[str]:
    """Length, number and letters of every segment."""
    n = len(text)
    k = _allowed(n, ladder)
    return [f"{n}.{i}.{text[a : a + size]}" for i, (a, size) in enumerate(_cuts(n, k))] if k else []


def probe_keys(text: str, ladder=LADDER, equal: bool = True) -> list[str]:
    """Keys of the segments of shorter or, with `equal`, equally long strings that `text` may hold."""
    n = len(text)
    keys: dict[str, None] = {}
    for m in range(max(1, n - ladder[0][1]), n + equal):
        k = _allowed(m, ladder)
        diff = n - m
        if diff > k or not k:
            continue
        for i, (start, size) in enumerate(_cuts(m, k)):
            # i segments lie left of this one and k - i right of it, each damaged at least once
            low = max(0, start - i, start + diff - (k - i))
            high = min(n - size, start + i, start + diff + (k - i))
            for at in range(low, high + 1):
                keys[f"{m}.{i}.{text[at : at + size]}"] = None
    return list(keys)


def node_keys(text: str, ladder=LADDER) -> list[str]:
    """Keys of a node that is to be met by probes of any length: below "<" as the shorter one or of equal length, below ">" as the longer one."""
    return [f"<{k}" for k in index_keys(text, ladder)] + [f">{k}" for k in probe_keys(text, ladder, equal=False)]


def asking_keys(text: str, ladder=LADDER) -> list[str]:
    """Keys of a probe against `node_keys`."""
    return [f"<{k}" for k in probe_keys(text, ladder)] + [f">{k}" for k in index_keys(text, ladder)]


def _keys_udf(fn, ladder):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: fn(t, ladder))

    return run.asNondeterministic()


def similar_pairs(nodes: DataFrame, probes: DataFrame | None = None, ladder=LADDER) -> DataFrame:
    """Pairs (block, a, b) of different strings within the ladder's distance; a is not longer than b.

    `nodes`: distinct (block, text). With `probes` (distinct block, text), only pairs of a probe
    and a node, as (block, a = node, b = probe), in either order of length; both orders are one join. Null or empty
    texts match nothing. The keys are never broadcast: how many a text has is not known to the planner, which takes their
    table for as small as that of the texts.
    """
    both = probes is not None
    nodes = nodes.filter(F.length("text") > 0)
    probes = nodes if probes is None else probes.filter(F.length("text") > 0)
    a, b = F.col("a"), F.col("b")
    top = max(k for _, k in ladder)

    def side(df: DataFrame, fn, name: str) -> DataFrame:
        keys = _keys_udf(fn, ladder)(F.col("text"))
        return df.select("block", F.col("text").alias(name), keys.alias("ks")).select("block", name, F.explode("ks").alias("k"))

    if both:
        found = side(nodes, node_keys, "a").join(side(probes, asking_keys, "b").hint("merge"), ["block", "k"]).filter(a != b)
    else:
        order = F.when(F.length(a) == F.length(b), a < b).otherwise(F.length(a) < F.length(b))
        found = side(nodes, index_keys, "a").join(side(probes, probe_keys, "b").hint("merge"), ["block", "k"]).filter(order)
    return found.select("block", "a", "b").distinct().filter(F.levenshtein(a, b, top).between(0, edits(F.least(F.length(a), F.length(b)), ladder)))
