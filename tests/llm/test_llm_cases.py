import json
import random

from pyspark.sql import functions as F

from contactweave.llm import leak_search, org_names, places, reference_match, segment_join, stuffing, tokenizing
from test_llm import LISTING, surroundings


# ------------------------------------------------------------------ problem 10
def test_variants_of_one_list_stay_stuffed(spark):
    rng = random.Random(7)
    small = "the a of and to in is was we they it on for with at by from that this our you".split()
    # prose: half function words, half words of a wide vocabulary
    prose = [(i, "en", " ".join(rng.choice(small) if rng.random() < 0.5 else f"p{chr(97 + i % 26)}{rng.randrange(900)}x" for _ in range(rng.choice((40, 90, 120))))) for i in range(120)]
    # one source's keyword list in other orders with another word each, a third of all texts
    keys = ("cheap boiler repair discount driving lessons flower delivery near best price " * 5).split() + [f"town{i}q" for i in range(12)]
    spam = []
    for i in range(60):
        words = rng.sample(keys, len(keys))
        words[rng.randrange(len(words))] = f"other{i}z"
        spam.append((1000 + i, "en", " ".join(words)))
    df = spark.createDataFrame([*prose, *spam], "doc_id long, lang string, text string")
    assert {r["doc_id"] for r in stuffing.stuffed_documents(df).collect()} == {i for i, _, _ in spam}


def test_extreme_curve_flags_by_itself_at_its_length(spark):
    rows = [(1, 100, -1.1, 0.2, 0.8, 0.6, 1.0), (2, 100, -0.5, 0.6, 0.8, 0.6, 1.0), (3, 100, -0.5, 0.2, 0.8, 0.6, 4.0), (4, 20_000, -1.1, 0.2, 0.1, 0.6, 1.0), (5, 5, -1.0, 0.0, 0.8, 0.6, 1.0), (6, 100, -0.5, 0.2, 0.4, 0.1, 2.5)]
    df = spark.createDataFrame(rows, "id long, n long, slope double, residual double, extent double, function_share double, divergence double")
    assert {r["id"] for r in stuffing.flagged(df).filter("stuffed").collect()} == {1, 2, 6}


def test_any_number_of_languages_gives_the_same_features(spark):
    rng = random.Random(3)
    words = {lang: [f"{lang}{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)] for lang in ("en", "de", "fr", "xx")}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60)))) for i, lang in enumerate(["en", "de", "fr", "xx"] * 20)] + [(900, None, "??"), (901, "en", "zz 12 12")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    get = lambda n: {bytes(r["key"]): r for r in stuffing.page_features(df, n).collect()}
    wide, long = get(40), get(2)
    assert len(wide) == len(long) == 81
    for k, r in wide.items():
        assert r["language"] == long[k]["language"] and all(abs(r[c] - long[k][c]) < 1e-9 for c in ("divergence", "function_share", "slope", "residual", "extent"))


# ------------------------------------------------------------------ problem 4
def _linked(spark, rows):
    city = spark.createDataFrame([("T1", "Saint Novbri", None, "DE"), ("T2", "Golzeldun", "Zelnilsøl", "DE")], "city_key string, city_name string, alt_name string, country_code string")
    country = spark.createDataFrame([("DE", "Germany", "DEU", "Deutschland")], "country_code string, country_name string, iso3 string, native_name string")
    df = spark.createDataFrame([*((i, n, None, c, "DE", None, phone, None, None) for i, n, c, phone in rows), *surroundings()], LISTING)
    return {tuple(r) for r in places.class_pairs(org_names.organisations(df, city, country), "listing_id", "org", "name").collect() if r[0] < 100_000}


def test_glued_name_meets_the_longer_form_of_another(spark):
    rows = [(1, "Bernovhamtipmar Bakery", "Golzeldun", None), (2, "Hamtipmar, Bernnov Bakery", "Golzeldun", None)]
    assert _linked(spark, rows) == {(1, 2)}


def test_listing_without_town_finds_it_by_parts_in_another_order(spark):
    rows = [(1, "Bernov Hamtipmar Bakery", "Golzeldun", "+49 555 01234"), (2, "Hamtipmar, Bernov - Bakery", None, "+49 555 01234"), (3, "Wixcal Novwenpel Bakery", "Golzeldun", None), (4, "Novwenpel Wixcal Bakery", None, None)]
    assert _linked(spark, rows) == {(1, 2), (3, 4)}


# ------------------------------------------------------------------ problems 3 and 9
def test_joined_towns_agree_with_the_trie(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bal cor dun fir gol har jas kel".split()) for _ in range(rng.choice((2, 3)))).title()
    towns = [(f"T{i}", ("Saint " if i % 7 == 0 else "") + word(), word() if i % 5 == 0 else None, rng.choice(("DE", "MT"))) for i in range(120)]
    countries = [("DE", "Germany", "DEU", "Deutschland"), ("MT", "Malta", "MLT", "Malta")]
    city, country = spark.createDataFrame(towns, "city_key string, city_name string, alt_name string, country_code string"), spark.createDataFrame(countries, "country_code string, country_name string, iso3 string, native_name string")

    def typed(name):
        s = list(name)
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randrange(len(s) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                s[at], s[at + 1] = s[at + 1], s[at]
            elif kind == 1 and len(s) > 3:
                del s[at]
            elif kind == 2:
                s.insert(at, rng.choice("abxyz"))
            else:
                s[at] = rng.choice("aeiou")
        return "".join(s).replace("Saint", rng.choice(("St.", "Saint", "san")))

    rows = []
    for i in range(400):
        _key, name, alt, code = rng.choice(towns)
        rows.append((i, json.dumps({"complete_address": {"city": typed(rng.choice((name, alt or name))) + rng.choice(("", "", " (DE)", ", Malta")), "country": rng.choice((code, code, "MT", None, "nowhere"))}})))
    rows += [(900, json.dumps({"complete_address": {"city": "  ", "country": "DE"}})), (901, json.dumps({"complete_address": {"city": "zzzzzzzzzzz", "country": "DE"}}))]
    results = spark.createDataFrame(rows, "id long, data string")
    get = lambda limit: {tuple(r) for r in reference_match.map_towns(results, city, country, limit).collect()}
    shipped, joined = get(1000), get(10)
    assert shipped == joined and sum(r[2] != "UNMATCHED" for r in shipped) > 100
    near = {(r["rec_id"], r["ref_key"]): r["distance"] for r in reference_match.town_candidates(results, city, country).collect()}
    assert all((i, key) in near for i, _t, key in shipped if key != "UNMATCHED") and set(near.values()) <= {0, 1, 2}


def test_long_item_lists_are_searched_in_blocks(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(14))) for i in range(60)] + [(60, None), (61, "")]
    docs = [(i, "x y " + " ".join(items[rng.randrange(60)][1].split()[: rng.choice((9, 10, 14))]) + " z") for i in range(120)] + [(500, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    get = lambda n: sorted(tuple(r) for r in leak_search.leaks(d, b, max_items=n).collect())
    assert get(1000) == get(7) and len(get(1000)) > 40


def test_words_of_any_share_give_the_same_ids(spark):
    docs = [(i, "the same text again") for i in range(95)] + [(200, None), (201, ""), (202, "another one"), (203, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [{r["doc_id"]: tuple(r["ids"]) for r in tokenizing.encode_corpus(d, hot_share=share).collect()} for share in (1e-5, 0.2, 0.9)]
    got = rows[0]
    assert rows[0] == rows[1] == rows[2]
    assert len(got) == 99 and len({got[i] for i in range(95)}) == 1 and got[0] and got[200] == got[201] == got[203] == () and got[202] != got[0]


# ------------------------------------------------------------------ recall against brute force and generated truth
def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_segment_join_finds_every_pair(spark):
    """All pairs within the distance, and no other, in both forms of the join."""
    rng = random.Random(21)
    texts = set()
    for _ in range(40):
        base = "".join(rng.choice("abcd") for _ in range(rng.choice((4, 5, 6, 8, 9, 13, 14, 17))))
        texts.add(base)
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice(([], [s[at], rng.choice("abcd")], [rng.choice("abcd")]))
                s = s or ["a"]
            texts.add("".join(s))
    allowed = lambda n: next((k for least, k in segment_join.LADDER if n >= least), 0)
    rows = [(block, t) for block in ("x", "y") for t in sorted(texts) if block == "x" or len(t) % 2]
    df = spark.createDataFrame(rows, "block string, text string")
    got = {tuple(r) for r in segment_join.similar_pairs(df).collect()}
    near = lambda a, b: a != b and _levenshtein(a, b) <= allowed(min(len(a), len(b)))
    want = {(k, *sorted((a, b), key=lambda t: (len(t), t))) for k in ("x", "y") for q, a in rows if q == k for r, b in rows if r == k and near(a, b)}
    assert got == want and len(want) > 100
    probes = spark.createDataFrame([(k, t) for k, t in rows][::5], "block string, text string")
    asked = [tuple(r) for r in probes.collect()]
    both = {tuple(r) for r in segment_join.similar_pairs(df, probes).collect()}
    assert both == {(k, a, b) for k, b in asked for q, a in rows if q == k and near(a, b)}


def test_recall_on_generated_organisations(spark):
    """Spellings made by rules of their own: typing errors, other orders, words written together, short trades, legal forms."""
    rng = random.Random(33)
    syllables = "bal cor dun fir gol har jas kel lum mar nov ost pel qua rus sel tam ulf vel wix".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).title()
    trades = (("Bakery", "Bkry", "bakery"), ("Dental Clinic", "Dental Clin.", "dental_clinic"), ("Book Store", "Book Store", "book_store"), ("Plumbing Svcs", "Plumbing Svcs", "plumber"))

    def slip(s):
        at = rng.randrange(1, len(s) - 2)
        return rng.choice((s[:at] + s[at + 1] + s[at] + s[at + 2 :], s[:at] + s[at + 1 :], s[:at] + s[at] + s[at:]))

    truth, rows, i = {}, [], 0
    for org in range(120):
        town = rng.choice(("Golzeldun", "Saint Novbri"))
        a, b = word(3), word(3)
        full, short, _cat = rng.choice(trades)
        kinds = [f"{a} {b} {full}", f"{a} {b} {short} Ltd.", f"{b}, {a} - {full}", f"{slip(a)} {b} {full}", f"{a}{b} {full}", f"{a} {slip(b)} {short}", f"{a.upper()} & {b.upper()} {full.upper()}"]
        for name in rng.sample(kinds, 4):
            rows.append((i, name, town, None))
            truth[i] = org
            i += 1
    got = _linked(spark, rows)
    want = {(x, y) for x in truth for y in truth if x < y and truth[x] == truth[y] and rows[x][1] != rows[y][1]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)


def test_recall_on_generated_addresses(spark):
    rng = random.Random(35)
    syllables = "bal cor dun fir gol har jas kel lum mar nov ost pel qua rus sel tam ulf vel wix".split()
    city = spark.createDataFrame([("T1", "Saint Novbri", None, "DE"), ("T2", "Golzeldun", None, "DE")], "city_key string, city_name string, alt_name string, country_code string")
    country = spark.createDataFrame([("DE", "Germany", "DEU", "Deutschland")], "country_code string, country_name string, iso3 string, native_name string")
    streets = [("".join(rng.choice(syllables) for _ in range(4)).title(), rng.choice((("Street", "St."), ("Road", "Rd"), ("Avenue", "Ave."))), rng.choice(("Golzeldun", "Saint Novbri"))) for _ in range(30)]
    truth, rows = {}, []
    for i in range(900):
        s = rng.randrange(30)
        name, (long, short), town = streets[s]
        number = str(rng.randrange(1, 12))
        if rng.random() < 0.15:
            at = rng.randrange(1, len(name) - 2)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
        kind = rng.choice((long, short, short.lower(), long.upper()))
        text = rng.choice((f"{number} {name} {kind}", f"{name} {kind}, No. {number}", f"Flat {rng.randrange(9) + 1}, {number} {name} {kind}", f"{name} {kind} #{number}", f"{number}, {name}"))
        rows.append((i, text, rng.choice((town, town.lower())), "DE"))
        truth[i] = (s, number)
    placed = places.match_places(spark.createDataFrame(rows, "rec_id long, street string, city string, country string"), city, country)
    got = {tuple(r) for r in places.class_pairs(placed, "rec_id", "place").collect()}
    want = {(x, y) for x in truth for y in truth if x < y and truth[x] == truth[y]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.99 * len(got)


def test_copies_that_are_no_pair_cost_nothing(spark):
    """A third of all rows are copies of one spelling: they meet the other spellings only."""
    df = spark.range(60_000).select(
        F.col("id").alias("k"), F.when(F.col("id") < 20_000, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 20_000).cast("string"))).alias("c"),
        F.when(F.col("id") < 19_998, F.lit("same")).otherwise(F.concat(F.lit("n"), (F.col("id") % 3).cast("string"))).alias("t"),
    )
    pairs = places.class_pairs(df, "k", "c", "t")
    got = pairs.agg(F.count("*"), F.count(F.when(F.col("k_b") < 20_000, 1)), F.count(F.when(F.col("k_a") >= F.col("k_b"), 1))).first()
    small = df.filter("k >= 20000").groupBy("c", "t").count().groupBy("c").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q")).agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0]
    assert (got[1], got[2]) == (19_998 * 2 + 1, 0) and got[0] == got[1] + small


# ------------------------------------------------------------------ what the driver holds of problem 4
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_looked_up_in_one_join_and_keys_not_broadcast(spark):
    nodes = spark.createDataFrame([("t", "bernovhamtipmar"), ("t", "othername")], "block string, text string")
    probes = spark.createDataFrame([("t", "bernovhamtipma"), ("t", "beernovhamtipmar"), ("t", "bernovhamtipmar")], "block string, text string")
    pairs = segment_join.similar_pairs(nodes, probes)
    for plan in (_plan(pairs), _plan(segment_join.similar_pairs(nodes))):
        assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan
    assert {tuple(r) for r in pairs.collect()} == {("t", "bernovhamtipmar", "bernovhamtipma"), ("t", "bernovhamtipmar", "beernovhamtipmar")}


def test_pairs_of_organisations_plan_no_step_before_the_classes(spark):
    city = spark.createDataFrame([("T1", "Golzeldun", None, "DE")], "city_key string, city_name string, alt_name string, country_code string")
    country = spark.createDataFrame([("DE", "Germany", "DEU", "Deutschland")], "country_code string, country_name string, iso3 string, native_name string")
    rows = [(1, "Bernov Hamtipmar Bakery", None, "Golzeldun", "DE", None, None, None, None), (2, "Hamtipmar, Bernov - Bakery", None, "Golzeldun", "DE", None, None, None, None)]
    pairs = places.class_pairs(org_names.organisations(spark.createDataFrame([*rows, *surroundings()], LISTING), city, country), "listing_id", "org", "name")
    plan = _plan(pairs)
    assert "Python" not in plan and plan.count("Scan") == plan.count("Scan ExistingRDD") > 0
    assert (1, 2) in {tuple(r) for r in pairs.collect()}
