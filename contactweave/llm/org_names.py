"""Variant spellings of names of organisations and practitioners: pigeonhole segment join (problem 4).

A name is taken apart into its core (the words that name this one organisation), the person's
first name, and its trade; legal forms, titles and trade words say nothing about who it is. Which words
tell a trade and which stand in names of all kinds is counted over all rows (`learn_lexicon`): a trade
word goes with one category wherever it occurs, a filler word is frequent and goes with all.

Cores of one town are linked when a segment join finds them within a length-dependent distance; parts
in another order and words written together are covered because the core is joined without spaces
and has further forms: its rotations up to four words, and its words in sorted order whatever their
number. A class of cores is a star: every core lies within the distance of its representative, the
spelling with most listings around, so classes don't chain. Inside a class, people are told apart
by first name (initials and nicknames resolved) and firms by trade, so relatives and firms of one
family name stay apart. A listing that leaves one of these out takes it from the only candidate in
its class, else from the listings at the same house number, else from its categories; if that does
not decide, it stays alone.

Everything is keyed by distinct (town, core); a name repeated in a third of all rows is one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.address_parse import parse as parse_address
from contactweave.llm.components import ensure_checkpoint_dir, stars
from contactweave.llm.encoding_repair import repair
from contactweave.llm.folding import damerau, fold, folded
from contactweave.llm.places import SEP, inherit_towns
from contactweave.llm.reference_match import Countries, Towns, _Memo, load_countries, load_towns
from contactweave.llm.segment_join import similar_pairs

# ---------------------------------------------------------------- fixed values: words that name no one
#: Legal forms, titles and joining words, folded.
PLAIN_WORDS = frozenset(
    "ltd limited inc incorporated corp corporation llc llp lp plc pty gmbh mbh gbr ohg ek ev kg kgaa ug ag sa sl slu sll sarl sasu eurl sas sci snc sc srl srls spa sapa bv nv vof cv cie co company "
    "oy ab as asa aps ks sp zoo kft bt zrt sro doo dd ood eood ou uab sia sons son fils hijos figli sohne brothers bros gebr freres hermanos fratelli "
    "dr dipl ing prof mag mr mrs ms herr frau and und y et e u i o of the n de des du d l la las los el le les il lo di del della der die das den von van zu zum zur".split()
)
#: First names with their short forms, folded; the first of each group stands for it.
FIRST_NAMES = (
    "robert bob rob", "joseph joe", "michael mike", "catherine cathy cath kate", "margaret peggy maggie", "theodore ted theo",
    "elizabeth liz lizzie beth", "victoria vicky", "katharina kathi", "johannes hannes hans", "elisabeth lisl", "dorothea dorte thea",
    "sebastian basti", "maximilian max", "friedrich fritz", "wilhelmina minna", "frederic fred", "gregoire greg", "dominique dom",
    "mathilde tilde", "sebastien seb", "nathalie nath", "alexandre alex", "veronique vero", "concepcion concha", "mercedes merche",
    "rafael rafa", "francisco paco", "guadalupe lupe", "eduardo edu", "ignacio nacho", "dolores lola", "vincenzo enzo",
    "salvatore toto", "eleonora nora", "domenico mimmo", "francesca cesca", "lorenzo renzo", "raffaella lella", "giuseppe beppe",
    "william bill will", "thomas tom", "james jim", "richard dick", "maria", "anna", "peter pete", "john jack johnny", "stefan", "pierre", "marie", "jose pepe", "juan", "carlos",
    "luigi gigi", "giovanni gianni", "daniel danny", "david dave", "charles charlie", "edward eddie", "andrew andy", "anthony tony", "benjamin ben", "christopher chris", "nicholas nick",
    "patricia trish", "susan susie", "jennifer jenny", "matthew matt", "stephen steve", "andreas andi", "heinrich heinz", "gabriele gabi", "antonio toni", "manuel manolo", "enrique quique",
)

_FIRST = {w: g.split()[0] for g in FIRST_NAMES for w in g.split()}


def _letters(w: str) -> int:
    """Set of letters as bits: an edit changes at most two of them."""
    bits = 0
    for c in w:
        bits |= 1 << (ord(c) & 31)
    return bits


_LONG_FIRST = [(w, _letters(w)) for w in sorted(_FIRST) if len(w) >= 5]


def _nearest(w: str, words: list[tuple[str, int]], limit: int) -> str | None:
    """Nearest word within `limit` edits, the first in order of ties."""
    bits, best = _letters(w), (limit + 1, "")
    for x, known in words:
        if abs(len(x) - len(w)) <= limit and (bits ^ known).bit_count() <= 2 * limit:
            d = damerau(w, x, limit)
            if d < best[0]:
                best = (d, x)
    return best[1] or None


_TAIL = re.compile(r"\s+[–—•…|]\s*.*$|\s+[?�]\s+.*$|\s*[©™®]\s*$|\s+\d+\s?°\s*$")
_QUOTED = re.compile(r"[“\"«„][^“”\"«»„]*[”\"»“]|[?�][^\s?�]+[?�](?=\s|$)")
_DASH = re.compile(r"(?<=\w)[–—](?=\w)")
_SIGN = re.compile(r"(?<=[\w.])tm\s*$")
_INITIALS = re.compile(r"\b([a-z])\.([a-z])\.(?:([a-z])\.?)?(?:([a-z])\.?)?(?![a-z])")
_BETWEEN = re.compile(r"[\s,;:&+/()\"“”«»|]+")
_NO_WORD = re.compile(r"[^\w?�]")
_HYPHEN = re.compile(r"[-–—]")
_CATEGORY_CUT = re.compile(r"[;,|/\t\n\r•·&]|\s(?:and|or|und|oder)\s")
MAX_WORDS = 100_000


def slugs_of(categories: str | None) -> list[str]:
    """Category names of a field as folded words joined by underscores."""
    if not categories:
        return []
    items = (re.sub(r"[\s_]+", "_", x.strip(" '\"[]\t")) for x in _CATEGORY_CUT.split(fold(categories)))
    return sorted({x for x in items if x})


class Lexicon:
    """What a word in a name stands for: learned trade and filler words beside the fixed ones."""

    def __init__(self, learned: Iterable[tuple[str, str]] = ()):
        self.trade: dict[str, str] = {}
        self.filler: set[str] = set()
        for word, trade in learned:
            if word in PLAIN_WORDS or word in _FIRST:
                continue
            if trade:
                self.trade[word] = trade
            else:
                self.filler.add(word)
        self.trades = frozenset(self.trade.values())
        self.long = [(w, _letters(w)) for w in sorted({*self.trade, *self.filler, *PLAIN_WORDS}) if len(w) >= 6]
        self._kinds, self._firsts = _Memo(), _Memo()

    def kind(self, w: str) -> tuple[str, str]:
        """('first', name) / ('trade', trade) / ('plain', '') / ('filler', w) / ('core', w) of one folded word."""
        got = self._kinds.get(w)
        return got if got is not None else self._kinds.put(w, self._kind(w))

    def _kind(self, w: str) -> tuple[str, str]:
        if w in _FIRST:
            return "first", _FIRST[w]
        if w in self.trade:
            return "trade", self.trade[w]
        if w in PLAIN_WORDS or w.isdigit():
            return "plain", ""
        if w in self.filler or w.rstrip("?�") in self.filler:
            return "filler", w
        if len(w) >= 5:
            x = _nearest(w, self.long, 1 if len(w) < 9 else 2)
            if x:
                return ("trade", self.trade[x]) if x in self.trade else ("filler", w) if x in self.filler else ("plain", "")
        return "core", w

    def near_first(self, w: str) -> str:
        """First name one edit away, '' without one."""
        got = self._firsts.get(w)
        if got is None:
            x = _nearest(w, _LONG_FIRST, 1) if len(w) >= 5 else None
            got = self._firsts.put(w, _FIRST[x] if x else "")
        return got

    def take_apart(self, name: str | None) -> tuple[str, list[str], str, list[str]]:
        """(core without spaces, its other forms, first name or initial, trades) of a name."""
        if name is None or not name.strip():
            return "", [], "", []
        s = _SIGN.sub("", _DASH.sub("-", _QUOTED.sub(" ", fold(repair(name)[0]))))  # a trademark sign may be written out
        core, first, trades = self._words(_TAIL.sub(" ", s))
        if len(core) < 2 and len("".join(core)) < 9:  # the dash stood inside the name
            core, first, trades = self._words(s)
        joined = "".join(core)
        forms = {"".join(core[i:] + core[:i]) for i in range(1, len(core))} if len(core) <= 4 else set()
        forms.add("".join(sorted(core)))
        return joined, sorted(forms - {joined}), first, trades

    def _words(self, s: str) -> tuple[list[str], str, list[str]]:
        s = _INITIALS.sub(lambda m: "".join(x or "" for x in m.groups()), s)
        core: list[str] = []
        filler: list[str] = []
        foreign: list[str] = []
        trades: dict[str, None] = {}
        first = initial = ""
        for raw in _BETWEEN.split(s):
            if not raw or raw in "-–—•…":
                continue
            if len(raw) == 2 and raw[1] == "." and "a" <= raw[0] <= "z" and raw[0] != "u":
                initial = initial or raw[0]
                continue
            if raw.startswith(("d'", "l'")):
                raw = raw[2:]
            glued = raw.replace(".", "").replace("'", "")
            parts = [glued]
            if "-" in glued or "–" in glued or "—" in glued:
                whole = glued.replace("-", "")
                parts = [whole] if self.kind(whole)[0] in ("trade", "plain") else _HYPHEN.split(glued)
            for w in parts:
                w = _NO_WORD.sub("", w)
                if not w.strip("?�") or any(c.isdigit() for c in w):
                    continue
                if not ("a" <= max(w) and any("a" <= c <= "z" for c in w)) and "?" not in w:
                    foreign.append(w)  # beside Latin words, a word in another script decorates
                    continue
                kind, value = self.kind(w)
                if kind == "first":
                    first = first or value
                elif kind == "trade":
                    trades[value] = None
                elif kind == "filler":
                    filler.append(w)
                elif kind == "core" and len(w) > 1:
                    core.append(w)
        if not first and len(core) > 2:  # a misspelt first name stands beside the family's two words
            at = next((i for i, w in enumerate(core) if self.near_first(w)), None)
            if at is not None:
                first = self.near_first(core.pop(at))
        # a name of nothing but frequent words is named by them, one in another script by that
        return core or filler or foreign, first or initial, list(trades)


def learn_lexicon(
    listings: DataFrame, trade_share: float = 0.8, min_trade: float = 1e-4, min_filler: float = 6e-4, least: int = 10, buckets: int = 16, limit: int = MAX_WORDS
) -> list[tuple[str, str]]:
    """(word, trade) of trade words and (word, '') of filler words, counted over all rows.

    Rows are counted by word, category and bucket of towns. A trade word occurs in a share of at least
    `min_trade` of the names and in a quarter of the buckets, and in three of four of its buckets a share
    of at least `trade_share` of its rows with categories (`least` in all) has the same one; so neither one large
    organisation nor one town can make a trade word. A filler word has a share of at least `min_filler`,
    in half of the buckets. A word of this share can't be one of more than (words a name) / `min_trade`,
    which bounds what comes to the driver; `limit` checks it.
    """
    text = F.regexp_replace(folded(F.col("name")), r"(?<=\b\p{L})\.(?=\p{L}\b)", "")
    raw = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.'-]*"), F.lit(0))
    bare = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, "^[dl]'", ""), "[.']", ""))
    words = F.array_distinct(F.filter(F.concat(F.flatten(F.transform(bare, lambda w: F.split(w, "-"))), F.transform(bare, lambda w: F.replace(w, F.lit("-"), F.lit("")))), lambda w: F.length(w) > 1))
    cut = F.split(folded(F.col("google_business_categories")), _CATEGORY_CUT.pattern)
    slugs = F.filter(F.array_distinct(F.transform(cut, lambda x: F.regexp_replace(F.regexp_replace(x, "^[ '\"\\[\\]]+|[ '\"\\[\\]]+$", ""), r"[\s_]+", "_"))), lambda x: x != "")
    none = F.array().cast("array<string>")
    marks = F.concat(F.array(F.lit("")), F.when(F.size(slugs) > 0, F.concat(F.array(F.lit("*")), slugs)).otherwise(none))
    bucket = F.pmod(F.hash(F.lower(F.trim(F.coalesce("city", F.lit(""))))), F.lit(buckets))
    per = (
        listings.filter(F.length(F.trim("name")) > 0)
        .select(F.explode(words).alias("word"), marks.alias("marks"), bucket.alias("b"))
        .select("word", "b", F.explode("marks").alias("mark"))
        .groupBy("word", "mark").agg(*[F.count(F.when(F.col("b") == i, 1)).alias(f"b{i}") for i in range(buckets)])
        .select("word", "mark", F.array(*[F.col(f"b{i}") for i in range(buckets)]).alias("n"))
        .withColumn("total", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))
    )
    only = lambda c: F.max(F.when(c, F.col("n")))
    named = F.col("mark").isin("", "*")
    rows = (
        per.groupBy("word").agg(only(F.col("mark") == "").alias("all"), only(F.col("mark") == "*").alias("some"), F.max_by(F.struct("mark", "n"), F.when(~named, F.struct("total", "mark"))).alias("top"))
    )
    names = listings.filter(F.length(F.trim("name")) > 0).count()
    size = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x)
    spread = F.size(F.filter("all", lambda x: x > 0))
    kept = rows.filter((size >= F.lit(min_trade * names)) & (spread * 4 >= buckets)).limit(limit + 1).collect()
    if len(kept) > limit:
        raise ValueError(f"more than {limit} frequent words; raise min_trade")
    out = []
    for r in kept:
        here = [i for i in range(buckets) if r["some"] and r["some"][i]]
        agree = sum(r["top"]["n"][i] >= trade_share * r["some"][i] for i in here) if here and r["top"] else 0
        if len(here) * 4 >= buckets and agree * 4 >= 3 * len(here) and sum(r["some"]) >= least:
            out.append((r["word"], r["top"]["mark"]))
        elif sum(r["all"]) >= min_filler * names and sum(x > 0 for x in r["all"]) * 2 >= buckets:
            out.append((r["word"], ""))
    return sorted(out)


_PARTS = T.StructType(
    [
        T.StructField("town", T.StringType()),
        T.StructField("core", T.StringType()),
        T.StructField("forms", T.ArrayType(T.StringType())),
        T.StructField("first", T.StringType()),
        T.StructField("trade", T.StringType()),
        T.StructField("cats", T.ArrayType(T.StringType())),
        T.StructField("number", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("phones", T.ArrayType(T.StringType())),
        T.StructField("host", T.StringType()),
    ]
)
_PHONE_CUT = re.compile(r"[;,|\n\t•\"']| & | and | or | / ")
_EXTENSION = re.compile(r"(?i)ext.*")
_NO_DIGIT = re.compile(r"\D")
_HOST = re.compile(r"^(?:https?:)?(?://)?(?:[^/?#]*/url\?q=(?:https?:)?(?://)?)?(?:www\.)?([^/?#:]+)", re.I)


def _phones(phone: str | None) -> list[str]:
    """Last eight digits of every number of a field."""
    if not phone:
        return []
    return [d[-8:] for d in (_NO_DIGIT.sub("", _EXTENSION.sub("", p)) for p in _PHONE_CUT.split(phone)) if len(d) >= 7]


_AT = re.compile(r"@([^\s\"';,|&/]+)")


def _host(url: str | None, email: str | None) -> str:
    for text, pattern in ((url, _HOST), (email, _AT)):
        m = pattern.search(text) if text else None
        if m:
            return m[1].lower()
    return ""


def parts_udf(towns: list[tuple], countries: list[tuple], lexicon: list[tuple[str, str]]):
    """`(name, street, city, country, categories, phone, url, email) -> parts`; `country`: the town's, else the one typed."""

    @F.pandas_udf(_PARTS)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        land, words = Countries(countries), Lexicon(lexicon)
        town_ref, memo, cat_memo = Towns(towns, land), _Memo(), _Memo()
        for cols in batches:
            out = []
            for name, street, city, country, cats, phone, url, email in zip(*cols):
                core, forms, first, trades = words.take_apart(name)
                if not core:
                    out.append(("", "", [], "", "", [], "", "", "", [], ""))
                    continue
                place = parse_address(street)
                town = ""
                for text in (city, place.tail):
                    if text and text.strip():
                        key = (text, country)
                        got = memo[key] if key in memo else memo.put(key, town_ref.match(text, country)[0])
                        if got:
                            town = got
                            break
                slugs = cat_memo[cats] if cats in cat_memo else cat_memo.put(cats, [c for c in slugs_of(cats) if c in words.trades])
                # of several trades in the name, the one that the categories name too
                trade = next((t for t in trades if t in slugs), trades[0] if trades else "")
                out.append((town, core, forms, first, trade, slugs, place.number or place.building, place.street, town_ref.country.get(town) or land.match(country) or "", _phones(phone), _host(url, email)))
            yield pd.DataFrame(out, columns=_PARTS.names)

    return run.asNondeterministic()


def resolve(first: str, trade: str, cats: list, here: list, house: list) -> tuple[str, str]:
    """(first, trade) of the organisation a listing belongs to.

    `here`: distinct (first, trade) in the class of cores, `house`: those at the same house number.
    """
    def fits(a: str, b: str) -> bool:
        return not a or not b or a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b))

    def complete(options) -> set[tuple[str, str]]:
        pairs = {(f, t) for f, t in options if fits(first, f) and fits(trade, t)}
        full = {(f, t) for f, t in pairs if t}
        pairs = full or pairs
        long = {(f, t) for f, t in pairs if len(f) > 1}
        # an initial or a missing first name gives way to the full name it fits
        return {
            (f, t) for f, t in pairs
            if len(f) > 1 or not any(t == t2 and fits(f, f2) for f2, t2 in long)
        } if long else pairs

    for options in (here, house):
        got = complete([(o[0], o[1]) for o in options])
        if len(got) == 1:
            return got.pop()
        if not trade and len(got) > 1:
            by_cat = {p for p in got if p[1] in cats}
            if len(by_cat) == 1:
                return by_cat.pop()
    return first, trade


_WHO = T.StructType([T.StructField("first", T.StringType()), T.StructField("trade", T.StringType())])


@F.pandas_udf(_WHO)
def resolve_udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for cols in batches:
        rows = []
        for first, trade, cats, here, house in zip(*cols):
            rows.append(
                resolve(first, trade, list(cats), [o.split(SEP) for o in here], [o.split(SEP) for o in house])
            )
        yield pd.DataFrame(rows, columns=_WHO.names)


resolve_udf = resolve_udf.asNondeterministic()


def organisations(sample_input: DataFrame, city_ref: DataFrame, country_ref: DataFrame) -> DataFrame:
    """listing_id, name, org (class id). Null and blank names, names without a core and listings whose town
    can't be told have no class. Every step ends in a checkpoint, so the driver plans one step at a time and
    not all of them once for every place that reads the classes."""
    ensure_checkpoint_dir(sample_input.sparkSession)
    udf = parts_udf(load_towns(city_ref), load_countries(country_ref), learn_lexicon(sample_input))
    base = (
        sample_input.filter(F.col("name").isNotNull())
        .select(
            "listing_id",
            "name",
            udf("name", "street", "city", "country_code", "google_business_categories", "phone_number", "url", "email").alias("p"),
        )
        .select("listing_id", "name", "p.*")
        .filter(F.col("core") != "")
        .checkpoint()
    )
    known = base.filter(F.col("town") != "")
    placed = known.unionByName(_towns_of_lost(base.filter(F.col("town") == ""), known, city_ref)).select(
        "listing_id", "name", "town", "core", "forms", "first", "trade", "cats", "number"
    )
    # spelling classes of cores inside a town; all forms of a core look each other up
    cores = placed.groupBy("town", "core").agg(F.count("*").alias("weight"), F.first("forms").alias("forms")).checkpoint()
    nodes = cores.select(F.col("town").alias("block"), F.col("core").alias("node"), F.explode(F.array_union(F.array("core"), "forms")).alias("text"))
    texts = nodes.select("block", "text").distinct()
    pairs = similar_pairs(texts).unionByName(texts.select("block", F.col("text").alias("a"), F.col("text").alias("b"))).checkpoint()  # a form may be that of several cores
    of = lambda x: nodes.select("block", F.col("text").alias(x), F.col("node").alias(f"core_{x}"))
    near = pairs.join(of("a"), ["block", "a"]).join(of("b"), ["block", "b"]).select("block", F.col("core_a").alias("a"), F.col("core_b").alias("b"))
    edges = near.filter("a <> b").distinct()
    ident = lambda c: F.concat_ws(SEP, "block", c)
    roots = stars(cores.select(F.concat_ws(SEP, "town", "core").alias("id"), "weight"), edges.select(ident("a").alias("a"), ident("b").alias("b")))
    rooted = placed.withColumn("id", F.concat_ws(SEP, "town", "core")).join(roots, "id", "left").select(
        "listing_id", "name", F.coalesce("root", "id").alias("root"), "first", "trade", "cats", "number"
    ).checkpoint()
    # who is who inside a class: at most (first names + initials) x trades entries per class, decided once per distinct kind of listing
    pair = F.concat("first", F.lit(SEP), "trade")
    here = rooted.groupBy("root").agg(F.collect_set(pair).alias("here"))
    house = rooted.filter(F.col("number") != "").groupBy("root", "number").agg(F.collect_set(pair).alias("house"))
    none = F.array().cast("array<string>")
    key = ["root", "number", "first", "trade", "cats"]
    decided = (
        rooted.select(*key).distinct().join(here, "root").join(house, ["root", "number"], "left")
        .select(*key, resolve_udf("first", "trade", "cats", "here", F.coalesce("house", none)).alias("who"))
    )
    return rooted.join(decided, key).select("listing_id", "name", F.concat_ws(SEP, "root", "who.first", "who.trade").alias("org")).checkpoint()


def _towns_of_lost(lost: DataFrame, known: DataFrame, city_ref: DataFrame) -> DataFrame:
    """The listings without a town, with the town that one kind of evidence names alone, else ''.

    First that of listings which share phone or site and the core, then that of the street, then the only
    town of the country with such a core. Phones, sites and countries are blocks of one lookup. Parts
    in another order count here as in a town.
    """
    spellings = F.explode(F.array_union(F.array("core"), "forms")).alias("text")
    marks = F.array_distinct(F.concat(F.transform("phones", lambda p: F.concat(F.lit("p:"), p)), F.array(F.concat(F.lit("h:"), "host"), F.concat(F.lit("c:"), "country"))))
    marks = F.filter(marks, lambda m: F.length(m) > 2)
    of_lost = lost.select("listing_id", F.explode(marks).alias("block"), "core", "forms").select("listing_id", "block", spellings).checkpoint()
    asked = of_lost.select("block", "text").distinct()
    there = (
        known.select("town", "core", "forms", F.explode(marks).alias("block"))
        .join(asked.select("block").distinct(), "block", "left_semi")
        .select("town", "block", spellings).groupBy("block", "text").agg(F.min("town").alias("low"), F.max("town").alias("high"))
    ).checkpoint()
    near = similar_pairs(there.select("block", "text"), asked).unionByName(asked.select("block", F.col("text").alias("a"), F.col("text").alias("b")))
    range_of = lambda c: (F.min(F.when(c, F.col("low"))), F.max(F.when(c, F.col("high"))))
    hits = near.join(there.withColumnRenamed("text", "a"), ["block", "a"]).groupBy("block", F.col("b").alias("text")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    land = F.col("block").startswith("c:")
    (m_low, m_high), (c_low, c_high) = range_of(~land), range_of(land)
    found = (
        of_lost.join(hits.checkpoint(), ["block", "text"]).groupBy("listing_id").agg(m_low.alias("m_low"), m_high.alias("m_high"), c_low.alias("c_low"), c_high.alias("c_high"))
        .select("listing_id", F.when(F.col("m_low") == F.col("m_high"), F.col("m_low")).alias("mark_town"), F.when(F.col("c_low") == F.col("c_high"), F.col("c_low")).alias("land_town"))
    )
    streets = known.filter(F.col("street") != "").select("town", "street").distinct().withColumn("street_id", F.concat_ws(SEP, "town", "street"))
    by_street = inherit_towns(
        lost.filter(F.col("street") != "").select("street", "country", F.lit("").alias("house")), streets, streets.limit(0).select("street_id", F.lit("").alias("house")), city_ref
    ).filter("as_town IS NOT NULL").select("street", "country", F.col("as_town").alias("street_town"))
    return (
        lost.drop("town").join(found, "listing_id", "left").join(by_street, ["street", "country"], "left")
        .withColumn("town", F.coalesce("mark_town", "street_town", "land_town", F.lit("")))
        .filter(F.col("town") != "")
        .drop("mark_town", "street_town", "land_town").checkpoint()
    )
