"""Same postal address written differently: top-down hierarchy matching (problem 6).

Records are linked level by level: country and town by the reference matcher, street among the
streets of that town, then kind of street and house number, or building; the unit is kept but makes no other
place. Spellings of a street form stars around the best supported one, so every spelling lies within
the edit distance of its representative and streets don't chain; two spellings that both have a good share of
the houses are two streets. A level that a record leaves out inherits the candidates of the levels below: a
record without a town takes the town in which its street and number occur, if there is one only, and
one without a kind of street takes the only kind known there. Ambiguity stays explicit (`towns`, `kinds` count the
candidates) and links nothing.

Work per level runs on distinct values, so repeated addresses cost nothing; the records
themselves are shuffled by house, where the class id is, never by town. Members of a class of
thousands are paired in blocks, so that no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.address_parse import parse
from contactweave.llm.components import ensure_checkpoint_dir, stars
from contactweave.llm.reference_match import Countries, Towns, _Memo, load_countries, load_towns, parsed_results
from contactweave.llm.segment_join import similar_pairs

_LEVELS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("town", "country", "street", "kind", "number", "building", "unit")]
)
#: Joins the parts of a node id; never part of a folded value.
SEP = "|"


def levels_udf(towns: list[tuple], countries: list[tuple]):
    """`(street, city, country) -> levels`; empty strings where a level is missing."""

    @F.pandas_udf(_LEVELS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ref = Countries(countries)
        town_ref, memo = Towns(towns, ref), _Memo()
        for street, city, country in batches:
            out = []
            for s, c, k in zip(street, city, country):
                p = parse(s)
                # a blank or unlisted city falls back on the town written behind the street
                town = ""
                for name in (c, p.tail):
                    if name and name.strip():
                        key = (name, k)
                        got = memo[key] if key in memo else memo.put(key, town_ref.match(name, k)[0])
                        if got:
                            town = got
                            break
                out.append((town, ref.match(k) or "", p.street, p.kind, p.number, p.building, p.unit))
            yield pd.DataFrame(out, columns=_LEVELS.names)

    return run.asNondeterministic()


def levels(records: DataFrame, city_ref: DataFrame, country_ref: DataFrame) -> DataFrame:
    """rec_id with its levels; `records`: (rec_id, street, city, country)."""
    udf = levels_udf(load_towns(city_ref), load_countries(country_ref))
    return records.select("rec_id", udf("street", "city", "country").alias("l")).select("rec_id", "l.*")


#: A spelling with so many houses, and this share of those of another one, is a street of its own; a typing error is rarer.
OWN_HOUSES, OWN_SHARE = 3, 0.25


def spelling_classes(nodes: DataFrame) -> DataFrame:
    """(block, text, root): every text with the id of its representative inside the block.

    `nodes`: distinct (block, text) with `weight` (records) and `houses` (distinct ones, 1 where that says nothing).
    """
    ident = lambda c: F.concat_ws(SEP, "block", c)
    of = lambda x: nodes.select("block", F.col("text").alias(x), F.col("houses").alias(f"n_{x}"))
    pairs = (
        similar_pairs(nodes.select("block", "text")).join(of("a"), ["block", "a"]).join(of("b"), ["block", "b"])
        .filter(F.least("n_a", "n_b") < F.greatest(F.lit(OWN_HOUSES), OWN_SHARE * F.greatest("n_a", "n_b"))).select(ident("a").alias("a"), ident("b").alias("b"))
    )
    roots = stars(nodes.select(ident("text").alias("id"), "weight"), pairs)
    return nodes.withColumn("id", ident("text")).join(roots, "id", "left").select("block", "text", F.coalesce("root", "id").alias("root"))


def house_of():
    """Number or building as one value; '' without either."""
    return F.when(F.col("number") != "", F.concat(F.lit("#"), "number")).when(F.col("building") != "", F.concat(F.lit("@"), "building")).otherwise("")


def inherit_towns(lost: DataFrame, streets: DataFrame, houses: DataFrame, city_ref: DataFrame) -> DataFrame:
    """street, country, house, towns (candidates), as_town and as_id (null unless decided) of addresses without a town.

    `lost`: (street, country, house) in any number; `streets`: (town, street, street_id); `houses`:
    distinct (street_id, house). Candidates lie in the record's country, where one is given, and hold
    its street in any spelling. One candidate decides; of several, the only one with the same house. Both
    levels are reduced to a row per distinct address before anything meets the records, so a street
    name that every town has multiplies no record.
    """
    keys = ["street", "country", "house"]
    lost = lost.select(*keys).distinct()
    spelled = lost.select(F.lit("*").alias("block"), F.col("street").alias("text")).distinct()
    everywhere = streets.select(F.lit("*").alias("block"), F.col("street").alias("text")).distinct()
    near = similar_pairs(everywhere, spelled).select(F.col("b").alias("street"), F.col("a").alias("as_street"), F.lit(1).alias("far"))
    near = near.unionByName(spelled.select(F.col("text").alias("street"), F.col("text").alias("as_street"), F.lit(0).alias("far")))
    where = city_ref.select(F.col("city_key").alias("town"), F.col("country_code").alias("town_country"))
    named = streets.select("town", F.col("street").alias("as_street"), "street_id").join(where, "town")
    # of several streets of one town, the one that is spelled alike goes first
    found = near.join(named, "as_street").groupBy("street", "town", "town_country", "street_id").agg(F.min("far").alias("far")).checkpoint()
    inside = (F.col("country") == "") | (F.col("country") == F.col("town_country"))
    only = [F.min(F.struct("far", "town", "street_id")).alias("low"), F.countDistinct("town").alias("n")]
    by_street = lost.select("street", "country").distinct().join(found, "street").filter(inside).groupBy("street", "country").agg(*only)
    by_house = (
        lost.filter("house <> ''").join(found.join(houses, "street_id"), ["street", "house"]).filter(inside).groupBy(*keys)
        .agg(*[c.alias(f"h_{x}") for c, x in zip(only, ("low", "n"))])
    )
    best = F.when((F.col("n") > 1) & (F.col("h_n") > 0), F.col("h_low")).otherwise(F.col("low"))
    return (
        lost.join(by_street, ["street", "country"]).join(by_house, keys, "left")
        .withColumn("towns", F.when((F.col("n") > 1) & (F.col("h_n") > 0), F.col("h_n")).otherwise(F.col("n")))
        .select(*keys, "towns", F.when(F.col("towns") == 1, best["town"]).alias("as_town"), F.when(F.col("towns") == 1, best["street_id"]).alias("as_id"))
    )


def match_places(records: DataFrame, city_ref: DataFrame, country_ref: DataFrame) -> DataFrame:
    """rec_id, place (class id, null without one), unit, towns and kinds (candidates for a missing town or kind of street).

    A record has no place without a house number or building, without a street and building, or
    while its town is missing and not decidable. Null and empty values are missing levels.
    """
    ensure_checkpoint_dir(records.sparkSession)
    rec = levels(records, city_ref, country_ref).filter(
        (F.col("number") != "") | (F.col("building") != "")
    ).withColumn("house", house_of()).checkpoint()

    # streets: spelling classes inside each town
    known = rec.filter(F.col("town") != "")
    spelled = known.filter(F.col("street") != "").groupBy(F.col("town").alias("block"), F.col("street").alias("text"), "house").agg(F.count("*").alias("n"))
    streets = spelling_classes(spelled.groupBy("block", "text").agg(F.sum("n").alias("weight"), F.count("*").alias("houses"))).select(
        F.col("block").alias("town"), F.col("text").alias("street"), F.col("root").alias("street_id")
    ).checkpoint()

    # a missing town inherits the towns with that street; several are narrowed by the house
    lost = rec.filter((F.col("town") == "") & (F.col("street") != ""))
    houses = known.select("town", "street", "house").distinct().join(streets, ["town", "street"]).select("street_id", "house").distinct()
    towns = inherit_towns(lost, streets, houses, city_ref)
    cols = ["rec_id", "number", "building", "kind", "unit"]
    placed = (
        known.join(streets, ["town", "street"], "left").select(*cols, F.lit(0).cast("long").alias("towns"), "town", "street_id")
        .unionByName(lost.join(towns, ["street", "country", "house"], "left").select(*cols, F.coalesce("towns", F.lit(0)).alias("towns"), F.col("as_town").alias("town"), F.col("as_id").alias("street_id")))
    ).checkpoint()

    # houses: number and kind of street, where a kind is given; a missing one takes the only kind there
    numbered = placed.filter((F.col("number") != "") & F.col("street_id").isNotNull())
    kinds = numbered.groupBy("street_id", "number").agg(F.countDistinct(F.nullif("kind", F.lit(""))).alias("kinds"))
    one = F.concat_ws(SEP, "street_id", F.lit("#"), "number")
    by_number = numbered.join(kinds, ["street_id", "number"]).select(
        "rec_id", "towns", "kinds", "unit", F.when(F.col("kinds") > 1, F.concat_ws(SEP, one, "kind")).otherwise(one).alias("place")
    )

    # buildings: spelling classes inside each street; without a street, the town's only one of the name
    named = placed.filter(F.col("number") == "")
    housed = named.filter(F.col("street_id").isNotNull())
    builds = spelling_classes(
        housed.groupBy(F.col("street_id").alias("block"), F.col("building").alias("text")).agg(F.count("*").alias("weight"), F.lit(1).alias("houses"))
    ).select(F.col("block").alias("street_id"), F.col("text").alias("building"), F.col("root").alias("building_id")).checkpoint()
    in_town = (
        housed.select("town", "street_id", "building").distinct().join(builds, ["street_id", "building"])
        .groupBy("town", "building")
        .agg(F.countDistinct("building_id").alias("n"), F.min("building_id").alias("only_id"))
        .filter("n = 1")
        .select("town", "building", "only_id")
    )
    by_building = (
        named.join(builds, ["street_id", "building"], "left").join(in_town, ["town", "building"], "left")
        .select("rec_id", "towns", F.lit(0).cast("long").alias("kinds"), "unit", F.coalesce("building_id", "only_id").alias("place"))
    )
    rest = placed.filter((F.col("number") != "") & F.col("street_id").isNull()).select("rec_id", "towns", F.lit(0).cast("long").alias("kinds"), "unit", F.lit(None).cast("string").alias("place"))
    return by_number.unionByName(by_building).unionByName(rest)


def listing_records(sample_input: DataFrame) -> DataFrame:
    return sample_input.select(
        F.col("listing_id").alias("rec_id"), "street", "city", F.col("country_code").alias("country")
    )


def result_records(results: DataFrame) -> DataFrame:
    a = F.col("j.complete_address")
    return parsed_results(results).select(
        F.col("id").alias("rec_id"), a["street"].alias("street"), a["city"].alias("city"), a["country"].alias("country")
    )


#: Members of a class that one task pairs with as many others.
BLOCK = 2000


def _pairs_inside(members: DataFrame, ident: str, key: str, block: int) -> DataFrame:
    """(key, ident_a, ident_b), the smaller first, of distinct (key, ident), in blocks of a hash of ident."""
    sizes = members.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").withColumn("__b", F.ceil(F.col("__n") / block).cast("int"))
    spread = members.select(key, ident).join(sizes, key).withColumn("__i", F.pmod(F.xxhash64(ident), F.col("__b")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__b") - 1))
    left = spread.select(key, F.col("__i").alias("__x"), every.alias("__y"), F.col(ident).alias(f"{ident}_a"))
    right = spread.select(key, every.alias("__x"), F.col("__i").alias("__y"), F.col(ident).alias(f"{ident}_b"))
    return left.join(right, [key, "__x", "__y"]).filter(F.col(f"{ident}_a") < F.col(f"{ident}_b")).select(key, f"{ident}_a", f"{ident}_b")


def class_pairs(members: DataFrame, ident: str, key: str, extra: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (smaller id first) of the members of a class, as the fixed result asks for; with `extra`, of members that differ in it.

    A class of more than `block` members is cut into blocks of about that size by a hash, and every pair of
    blocks is a key of its own: each member is sent once per block, and no task gets more than two blocks. With `extra` its
    distinct values are paired and then joined with their members, so copies that are no pair cost nothing. Ids are distinct.
    """
    inside = members.filter(F.col(key).isNotNull())
    if extra is None:
        return _pairs_inside(inside, ident, key, block).select(f"{ident}_a", f"{ident}_b")
    values = _pairs_inside(inside.select(key, extra).filter(F.col(extra).isNotNull()).distinct(), extra, key, block)
    of = lambda x: inside.select(key, F.col(extra).alias(f"{extra}_{x}"), F.col(ident).alias(f"__{x}"))
    both = values.join(of("a"), [key, f"{extra}_a"]).join(of("b"), [key, f"{extra}_b"])
    return both.select(F.least("__a", "__b").alias(f"{ident}_a"), F.greatest("__a", "__b").alias(f"{ident}_b"))


def class_members(members: DataFrame, ident: str, key: str, extra: str | None = None) -> DataFrame:
    """One row per member: its id, the class's smallest id as `class_id`, and `links`, the members it is paired with.

    With `extra`, members that don't differ in it are not linked. No pair is built.
    """
    inside = members.filter(F.col(key).isNotNull())
    sizes = inside.groupBy(key).agg(F.count("*").alias("__n"), F.min(ident).alias("class_id"))
    out = inside.join(sizes, key)
    if extra is None:
        return out.select(ident, "class_id", (F.col("__n") - 1).alias("links"))
    alike = inside.groupBy(key, extra).agg(F.count("*").alias("__m"))
    return out.join(alike, [key, extra]).select(ident, "class_id", (F.col("__n") - F.col("__m")).alias("links"))
