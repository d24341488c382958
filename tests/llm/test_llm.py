import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactweave.llm import address_parse, components, encoding_repair, folding, leak_search, org_names, places, reference_match, residue, segment_join, stuffing, tokenizing

COUNTRIES = [("MT", "Malta", "MLT", "Malta"), ("DE", "Germany", "DEU", "Deutschland"), ("AT", "Austria", "AUT", "Österreich"), ("GB", "United Kingdom", "GBR", "United Kingdom")]
TOWNS = [("T1", "Saint Novbri", None, "MT"), ("T2", "Golzeldun", "Zelnilsøl", "DE"), ("T3", "Quadolzel", None, "DE"), ("T4", "Quadolzel", None, "AT")]
CITY_SCHEMA = "city_key string, city_name string, alt_name string, country_code string"
COUNTRY_SCHEMA = "country_code string, country_name string, iso3 string, native_name string"


def plain_distance(a, b):
    """Optimal string alignment, full table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


words = st.text(alphabet="abc", max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 3))
def test_banded_distance(a, b, limit):
    assert folding.damerau(a, b, limit) == min(plain_distance(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(words.filter(bool), min_size=1, max_size=8), words.filter(bool), st.integers(0, 2))
def test_trie_finds_all_within_distance(entries, value, limit):
    trie = reference_match.Trie()
    for e in entries:
        trie.add(e, e)
    assert trie.search(value, limit) == {e: d for e in set(entries) if (d := plain_distance(e, value)) <= limit}


# ------------------------------------------------------------------ problem 3
def test_country_and_town_matching():
    c = reference_match.Countries(COUNTRIES)
    for typed, want in (("mt", "MT"), ("M.T.", "MT"), ("Matla", "MT"), ("DE, DE", "DE"), ("Allemagne", "DE"), ("osterreich", "AT"), ("AUT", "AT"), ("AUS", None), ("Malta (MT)", "MT"), ("", None), (None, None), ("Marsland", None), ("UK", "GB")):
        assert c.match(typed) == want, typed
    t = reference_match.Towns(TOWNS, c)
    for typed, beside, want in (
        ("St. Novbri", "MT", "T1"), ("saint-novbri", None, "T1"), ("12345 Golzeldun", "DE", "T2"), ("golzedlun", "DE", "T2"), ("Zelnilsol", None, "T2"), ("Quadolzel", "at", "T4"),
        ("Quadolzel", None, None), ("City of Golzeldun", "DE", "T2"), ("Golzeldun (DE)", None, "T2"), ("n/a", "DE", None), (None, None, None), ("  ", None, None), ("x" * 5000, "DE", None),
    ):
        assert t.match(typed, beside)[0] == want, (typed, beside)


def test_map_frames(spark):
    city, country = spark.createDataFrame(TOWNS, CITY_SCHEMA), spark.createDataFrame(COUNTRIES, COUNTRY_SCHEMA)
    j = lambda c, k: '{"complete_address": {"city": "%s", "country": "%s"}}' % (c, k)
    rows = [(1, j("golzeldun", "DE")), (2, j("Golzeldun", "DE")), (3, j("nowhere at all", "DE")), (4, '{"complete_address": {"city": "golz'), (5, None), (6, "{}"), (7, j("golzeldun", "DE"))]
    got = {tuple(r) for r in reference_match.map_towns(spark.createDataFrame(rows, "id long, data string"), city, country).select("rec_id", "ref_key").collect()}
    assert got == {(1, "T2"), (3, "UNMATCHED"), (7, "T2")}
    z = spark.createDataFrame([(1, "mt", "x"), (2, "XX", "x"), (3, None, "x"), (4, "zz", "x"), (5, "MT", "x"), (6, " ", "x")], "id long, country_code string, typed string")
    assert {tuple(r) for r in reference_match.map_countries(z, country).select("rec_id", "ref_key").collect()} == {(1, "MT"), (4, "UNMATCHED")}
    assert reference_match.map_towns(spark.createDataFrame([], "id long, data string"), city, country).count() == 0


# ------------------------------------------------------------------ problems 4 and 6
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=5, max_size=17), st.integers(0, 10_000))
def test_segments_survive_edits(text, seed):
    rng = random.Random(seed)
    other = list(text)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(other) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            other.insert(at, rng.choice("abcd"))
        elif other and kind == 1:
            del other[min(at, len(other) - 1)]
        elif other:
            other[min(at, len(other) - 1)] = rng.choice("abcd")
    short, long = sorted((text, "".join(other)), key=len)
    k = next((k for least, k in segment_join.LADDER if len(short) >= least), 0)
    dist = [list(range(len(long) + 1))]
    for i, x in enumerate(short, 1):
        dist.append([i])
        for jj, y in enumerate(long, 1):
            dist[i].append(min(dist[i - 1][jj - 1] + (x != y), dist[i - 1][jj] + 1, dist[i][-1] + 1))
    if k and dist[-1][-1] <= k:
        assert set(segment_join.index_keys(short)) & set(segment_join.probe_keys(long))


def test_similar_pairs_and_components(spark):
    rows = [("t", x) for x in ("bernovhamtipmar", "beernovhamtipmar", "bernovhamtipma", "othername", "abc", "")] + [("u", "bernovhamtipmar")]
    nodes = spark.createDataFrame(rows, "block string, text string")
    pairs = {tuple(r) for r in segment_join.similar_pairs(nodes).collect()}
    assert pairs == {("t", "bernovhamtipma", "bernovhamtipmar"), ("t", "bernovhamtipmar", "beernovhamtipmar"), ("t", "bernovhamtipma", "beernovhamtipmar")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a long, b long")
    roots = {r["id"]: r["root"] for r in components.connected(spark.range(1, 60), edges).collect()}
    assert {roots[i] for i in range(1, 41)} == {1} and roots[51] == 50 and roots[45] == 45
    assert components.connected(spark.range(3), edges.limit(0)).count() == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Apt. 1, 167 Ulfhobčirsab Square, KONG 0553", ("ulfhobcirsab", "167", "")), ("Ulfhobcirsab Sq, No. 167", ("ulfhobcirsab", "167", "")), ("#156, mongolcirbriweg", ("mongolcirbri", "156", "")),
        ("House Nilhar Ôngsabcal Avenue", ("ongsabcal", "", "nilhar")), ("Rue Sabông Résidence Mürfen, 08193", ("sabong", "", "murfen")), ("80-B, Jort├«pquaral Ln, 59813", ("jortipquaral", "80b", "")), (None, ("", "", "")), ("", ("", "", "")),
    ],
)
def test_address_levels(text, want):
    p = address_parse.parse(text)
    assert (p.street, p.number, p.building) == want


def test_places(spark):
    city, country = spark.createDataFrame(TOWNS, CITY_SCHEMA), spark.createDataFrame(COUNTRIES, COUNTRY_SCHEMA)
    rows = [
        (1, "7 Dolharsabmur Road", "Golzeldun", "DE"), (2, "Dolharsabmur Rd. No. 7, Flat 2", "golzeldun", "DE"), (3, "7A Dolharsabmur Road", "Golzeldun", "DE"), (4, "Dolharsabmur Road", "Golzeldun", "DE"),
        (5, "nº 7, Dolhrasabmur", None, "DE"), (6, "7 Dolharsabmur Road", "Quadolzel", "DE"), (7, None, None, None), (8, "Wixsel House, Dolharsabmur Road", "Golzeldun", "DE"),
        (9, "Dolharsabmur Rd - House Wixsel", "Golzeldun", "DE"), (10, "7 Dolharsabmur Road", "Golzeldun", "DE"),
        (11, "12 Church Road", "Golzeldun", "DE"), (12, "12 Church Street", "Golzeldun", "DE"), (13, "12 Church Rd, Flat 3", "Golzeldun", "DE"), (14, "12 Church", "Golzeldun", "DE"),
        (15, "12345 Mainwater Street", "Golzeldun", "DE"), (16, "Mainwater St, No. 12345", "Golzeldun", "DE"), (17, "12346 Mainwater Street", "Golzeldun", "DE"),
        *((20 + i, f"{i + 1} Millfield Lane", "Golzeldun", "DE") for i in range(5)), *((30 + i, f"{i + 1} Hillfield Lane", "Golzeldun", "DE") for i in range(5)), (40, "2 Millfeild Lane", "Golzeldun", "DE"),
    ]
    rec = spark.createDataFrame(rows, "rec_id long, street string, city string, country string")
    placed = places.match_places(rec, city, country).checkpoint()
    got = {tuple(r) for r in places.class_pairs(placed, "rec_id", "place").collect()}
    # record 5 fits two towns of its country, 14 two kinds of street: they stay explicit and link nothing
    assert got == {(1, 2), (1, 10), (2, 10), (8, 9), (11, 13), (15, 16), (21, 40)}
    by = {r["rec_id"]: r for r in placed.collect()}
    assert by[5]["towns"] == 2 and by[14]["kinds"] == 2 and by[13]["unit"] == "flat 3" and len(by) == len([r for r in rows if r[0] not in (4, 7)])
    one_town = places.match_places(rec.filter("rec_id <> 6"), city, country)
    assert (1, 5) in {tuple(r) for r in places.class_pairs(one_town, "rec_id", "place").collect()}
    assert places.match_places(rec.limit(0), city, country).count() == 0


def test_street_of_every_town_narrowed_by_the_house(spark):
    """A street name that all towns have: the house decides, else nothing does."""
    towns = [(f"K{i}", f"Town{chr(97 + i // 26)}{chr(97 + i % 26)}burg", None, "DE") for i in range(40)]
    city, country = spark.createDataFrame(towns, CITY_SCHEMA), spark.createDataFrame(COUNTRIES, COUNTRY_SCHEMA)
    rows = [(i, f"{i + 1} Mainwater Street", t[1], "DE") for i, t in enumerate(towns)] + [(100 + i, "17 Mainwater Street", None, "DE") for i in range(30)] + [(200, "99 Mainwater Street", None, "DE")]
    placed = places.match_places(spark.createDataFrame(rows, "rec_id long, street string, city string, country string"), city, country)
    by = {r["rec_id"]: r for r in placed.collect()}
    assert all(by[100 + i]["place"] == by[16]["place"] and by[100 + i]["towns"] == 1 for i in range(30)) and by[200]["towns"] == 40 and by[200]["place"] is None


LISTING = "listing_id long, name string, street string, city string, country_code string, google_business_categories string, phone_number string, url string, email string"


def surroundings(first_id=100_000):
    """Listings of other organisations in other towns, from which trade and filler words can be learned."""
    rng = random.Random(11)
    kinds = (
        ("{} Bakery", "bakery"), ("{} Bkry Ltd.", "bakery"), ("{} Physiopraxis", "physiotherapist"), ("{} Dental Clinic", "dental_clinic"), ("Dental Clin. {}", "dental_clinic"), ("{} Book Store", "book_store"),
        ("{} Architects", "architect"), ("{} Plumbing Svcs", "plumber"), ("Guest House: {}", "hotel"), ("{} G.H.", "hotel"), ("Price {} Bakery", "bakery"), ("{} Book Store Price", "book_store"), ("Price {} Plumbing", "plumber"),
    )
    syllables = "bal cor dun fir gol har jas kel lum mar nov ost pel qua rus sel tam ulf vel wix".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(3)).title()
    return [
        (first_id + i, kinds[i % len(kinds)][0].format(f"{word()} {word()}"), None, f"Farplace {chr(97 + i % 23)}{chr(97 + i % 19)}", "MT", kinds[i % len(kinds)][1], None, None, None) for i in range(1300)
    ]


@pytest.fixture(scope="module")
def lexicon(spark):
    return org_names.learn_lexicon(spark.createDataFrame(surroundings(), LISTING))


def test_learned_words(lexicon):
    trades, filler = {w: t for w, t in lexicon if t}, {w for w, t in lexicon if not t}
    assert trades["bakery"] == trades["bkry"] == "bakery" and trades["physiopraxis"] == "physiotherapist" and trades["gh"] == trades["guest"] == "hotel" and trades["svcs"] == "plumber"
    assert "price" in filler and not {"firbal", "golgol"} & {w for w, _ in lexicon}


def test_one_large_organisation_makes_no_trade_word(spark):
    hot = [(i, "Wixcal Novwenpel Bakery", None, "Golzeldun", "DE", "bakery", None, None, None) for i in range(700)]
    got = dict(org_names.learn_lexicon(spark.createDataFrame([*surroundings(), *hot], LISTING)))
    assert got["bakery"] == "bakery" and "wixcal" not in got and "novwenpel" not in got
    assert org_names.learn_lexicon(spark.createDataFrame([], LISTING)) == []


def test_names_taken_apart(lexicon):
    core = org_names.Lexicon(lexicon).take_apart
    assert core("Guest House: Bernov + Hamtipmar")[0] == core("Bernov Hamtipmar G.H. Ltd.")[0] == "bernovhamtipmar"
    assert core("Dr. Vicky Dratam-Tamdolnan, Physiopraxis")[2:] == ("victoria", ["physiotherapist"])
    assert core("M. Dratam-Tamdolnan - Plumbing Svcs")[2:] == ("m", ["plumber"])
    assert core("Bernov Hamtipmar Bakery – Saint Novbri")[0] == "bernovhamtipmar"
    assert core(None) == ("", [], "", []) and core("  ")[0] == "" and core("Ltd.")[0] == ""
    assert core("Price & Sons")[0] == "price" and core("Μόδα Ελιά")[0] == "μοδαελια"  # nothing rarer names them
    five = core("Alba Bercor Cirdun Domfir Estgol Bakery")[1]
    assert five == [] and core("Domfir Bercor Estgol Alba Cirdun")[1] == ["albabercorcirdundomfirestgol"]


def linked(spark, rows):
    """Pairs among the given (id, name, city, country) beside learned surroundings."""
    city, country = spark.createDataFrame(TOWNS, CITY_SCHEMA), spark.createDataFrame(COUNTRIES, COUNTRY_SCHEMA)
    df = spark.createDataFrame([*((i, n, None, c, k, None, None, None, None) for i, n, c, k in rows), *surroundings()], LISTING)
    orgs = org_names.organisations(df, city, country).checkpoint()
    pairs = {tuple(r) for r in places.class_pairs(orgs, "listing_id", "org", "name").collect() if r[0] < 100_000}
    members = {r["listing_id"]: (r["class_id"], r["links"]) for r in places.class_members(orgs, "listing_id", "org", "name").collect()}
    return pairs, members


def test_organisations(spark):
    names = [
        (1, "Bernov Hamtipmar Bakery", "Golzeldun"), (2, "Beernov Ħamtîpmar Bkry Ltd.", "golzeldun"), (3, "Hamtipmar, Bernov - Bakery", "Golzeldun"), (4, "BERNOVHAMTIPMAR", "Golzeldun"),
        (5, "Bernov Hamtipmar Bakery", "St Novbri"), (6, None, "Golzeldun"), (7, "Dr. Robert Sel-Vanost, Dental Clinic", "Golzeldun"), (8, "Bob Sel-Vanost Dental Clin.", "Golzeldun"),
        (9, "Maria Sel-Vanost, Dental Clinic", "Golzeldun"), (10, "Wixcal Novwenpel Book Store", "Golzeldun"), (11, "Wixcal Novwenpel Architects", "Golzeldun"), (12, "Bernov Hamtipmar Bakery", "Golzeldun"),
        (13, "Bercor Cirdunta Albamek Bakery", "Golzeldun"), (14, "Albamek Bercor Cirdunta Bkry", "Golzeldun"), (15, "Cirdunta, Bercor Albamek Bakery", "Golzeldun"),
        (16, "Domfir Estgolta Firnovka Golharum Harjasin Bakery", "Golzeldun"), (17, "Golharum Domfir Harjasin Firnovka Estgolta Bakery", "Golzeldun"), (18, "Price & Sons", "Golzeldun"), (19, "PRICE & Sons Ltd", "Golzeldun"),
    ]
    pairs, members = linked(spark, [(i, n, c, "DE" if c.lower() == "golzeldun" else "MT") for i, n, c in names])
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 12), (3, 12), (4, 12), (7, 8), (13, 14), (13, 15), (14, 15), (16, 17), (18, 19)}
    assert members[1] == (1, 3) and members[2] == (1, 4) and members[5] == (5, 0) and members[8] == (7, 1) and 6 not in members
    city, country = spark.createDataFrame(TOWNS, CITY_SCHEMA), spark.createDataFrame(COUNTRIES, COUNTRY_SCHEMA)
    assert org_names.organisations(spark.createDataFrame([], LISTING), city, country).count() == 0


def test_hot_class_is_paired_in_blocks(spark):
    df = spark.range(150).select(F.col("id").alias("k"), F.when(F.col("id") < 120, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 10).cast("string"))).alias("c"), (F.col("id") % 7).cast("string").alias("t"))
    rows = [(r["k"], r["c"], r["t"]) for r in df.collect()]
    want = {(a, b) for a, c, t in rows for b, d, u in rows if a < b and c == d and t != u}
    got = [tuple(r) for r in places.class_pairs(df, "k", "c", "t", block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["k"], r["links"]) for r in places.class_members(df, "k", "c", "t").collect()} == {(a, sum(1 for b, d, u in rows if d == c and u != t)) for a, c, t in rows}


def test_stars_do_not_chain(spark):
    nodes = spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 1), ("e", 1), ("f", 2)], "id string, weight long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "e"), ("b", "a")], "a string, b string")
    assert {r["id"]: r["root"] for r in components.stars(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "f", "f": "f"}
    assert components.stars(nodes, edges.limit(0)).count() == 0


# ------------------------------------------------------------------ problem 5
def test_residue(spark):
    rows = [
        (1, "<p>Hello {{ first_name }}, welcome</p>"), (2, "<p>Use code [SPRING] now</p>"), (3, "<body><noscript>Please turn on JavaScript to use this site.</noscript><div></div></body>"),
        (4, "<p>Real text about bread.</p><noscript>Please turn on JavaScript to use this site.</noscript>"), (5, "<!-- {{ city }} --><p>Fine words here.</p>"), (6, None), (7, ""),
        (8, "<h1>Page not found</h1>"), (9, "<p>The garden is under construction until June, the shop is open.</p>"), (10, "<p>Lorem ipsum dolor sit amet</p>"), (11, '<input placeholder="Your text here"><p>We bake.</p>'),
        (12, "<p>%COMPANY%</p>"), (13, "<pre>Fatal error: Uncaught TypeError in /var/app/a/b.php:12</pre>"), (14, "<p>Our wine is called Lorem, our gin Ipsum.</p>"), (15, "<p>" + "word " * 100_000 + "</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert {r["page_id"] for r in residue.residue_pages(df.withColumn("kinds", F.lit(1))).collect()} == {1, 3, 8, 10, 12, 13}
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_residue_learns_filler_beside_the_known_passage(spark):
    rng = random.Random(2)
    made_up = "quellam dortis vantum erlisque porbam neltis".split()
    pages = [(i, f"<p>Lorem ipsum {' '.join(rng.sample(made_up, 4))}.</p><p>We are open on day {i} and bake bread.</p>") for i in range(12)]
    pages += [(100 + i, f"<p>We bake bread {i} times a day, our wine is called Lorem.</p>") for i in range(40)]
    pages += [(200, f"<p>{' '.join(made_up)}</p>"), (201, "<p>" + " ".join(rng.choice(made_up) for _ in range(300)) + "</p>"), (202, "<p>Vantum and Dortis bake bread for our neltis house, and more.</p>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert set(residue.learn(df)[1]) == set(made_up)
    assert {r["page_id"] for r in residue.residue_pages(df).collect()} == {*range(12), 200, 201}
    assert residue.Index().match("Hello {{ first_name }}") == "slot" and residue.Index().match("Hello [spring]") is None


# ------------------------------------------------------------------ problem 7
TYPED = ["Frézel & Čirsel", "Gaststätte Łodbézçãoğ", "Åħø Ñandű", "Physiopraxis – Söl"]


@pytest.mark.parametrize("text", TYPED)
@pytest.mark.parametrize("legacy", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251"])
def test_round_trip(text, legacy):
    garbled = text.encode("utf-8").decode(legacy, errors="ignore")
    if garbled.encode(legacy) == text.encode("utf-8"):
        assert encoding_repair.repair(garbled)[0] == text
        twice = garbled.encode("utf-8").decode("latin-1")
        assert encoding_repair.repair(twice)[0] == text


@pytest.mark.parametrize("text", [*TYPED, "“MAÇÃ” Farmacia", "“A IRMÃ” Bézfir", "Hungry? Bakery", "½ Price Shop™", "Мода Ναι", "À Voltâ", "N° 5", "plain"])
def test_typed_text_stays(text):
    assert encoding_repair.fix(text) == (text, [], False, False)


@pytest.mark.parametrize("text", ["Fr?mekwag", "Gr�n", "?azbal Street", "n? 17, Road", "Shop ? Fremek", "FrÈost Store"])
def test_altered(text):
    assert encoding_repair.fix(text)[3]


def test_repaired_frame(spark):
    df = spark.createDataFrame([(1, "FrÃ©zel", None), (2, None, "Gr?n"), (3, "", "ok"), (4, "a" * 100_000 + "Ã©", "x")], "listing_id long, name string, street string").withColumn("value", F.lit(1))
    got = {(r["listing_id"], r["field_name"]): r["restored"] for r in encoding_repair.repaired(df, "listing_id", ("name", "street")).collect()}
    assert set(got) == {(1, "name"), (2, "street"), (4, "name")} and got[(1, "name")] == "Frézel" and got[(2, "street")] is None


# ------------------------------------------------------------------ problem 8
def test_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tokenizing.load_ranks(f"{tokenizing.TOKENIZER_DIR}/{tokenizing.BYTE_BPE_50K}"), special_tokens={})
    texts = ["Hello world", "", None, "  a\n\n b  ", "<|endoftext|> x's 12345 é  ñ z", "日本語 текст 😀 á", "Hello world", "a" * 3000, " \t ", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (0, "again")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = tokenizing.encode_corpus(df).collect()
    assert len(rows) == len(texts) + 2
    got = {(r["doc_id"], tuple(r["ids"])) for r in rows}
    assert got == {(i, tuple(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (None, "x"), (0, "again")]}
    good = df.filter("doc_id > 0")
    back = {r["doc_id"]: r["text"] for r in tokenizing.decode_corpus(tokenizing.encode_corpus(good)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts) if i}
    assert tokenizing.encode_corpus(df.limit(0)).count() == 0


# ------------------------------------------------------------------ problem 9
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=40), st.lists(st.lists(st.sampled_from("a b c d".split()), min_size=2, max_size=8), min_size=1, max_size=4))
def test_search_agrees_with_brute_force(doc, items):
    span = 3
    search = leak_search.WuManber([(i, " ".join(w)) for i, w in enumerate(items)], span)
    runs = {tuple(doc[i : i + span]) for i in range(len(doc) - span + 1)}
    want = [i for i, w in enumerate(items) if any(tuple(w[k : k + span]) in runs for k in range(len(w) - span + 1))]
    assert search.find(" ".join(doc)) == want


def test_leaks(spark):
    item = "One two three four five six seven eight nine Çen eleven"
    docs = [(1, "x ONE, two three\nfour - five six seven eight nine cen y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "pad " * 50_000 + item), (1, item)]
    got = leak_search.leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)), spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 9), (1, 9), (5, 9)]


# ------------------------------------------------------------------ problem 10
def test_stuffing(spark):
    rng = random.Random(5)
    frames = ["the owner of {} said that it was open on {} and the price is fair", "we asked for {} and they told us to come to the shop in {} with a friend", "it is a short walk from {} to the old house of {} by the river"]
    prose = [(i, "en", ". ".join(rng.choice(frames).format(f"w{rng.random():.4f}"[3:], f"z{rng.randrange(999)}q") for _ in range(8))) for i in range(60)]
    spam = "cheap flowers golvan near me cheap flowers best cheap flowers golvan " * 12
    links = "\n".join(f"http://a{i}b.example/flowers cheap" for i in range(40))
    rows = [*prose, (100, "en", spam), (101, None, spam), (102, "en", links), (103, "en", None), (104, "en", ""), (105, "en", " .,; "), (106, "en", prose[0][2] + " flowers, cheap, best")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", F.lit("clash"))
    assert {r["doc_id"] for r in stuffing.stuffed_documents(df).collect()} == {100, 101, 102}
    assert stuffing.stuffed_documents(df.limit(0)).count() == 0
