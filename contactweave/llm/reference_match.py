"""Free-entered values mapped to a canonical list: trie with a Levenshtein automaton (problem 3).

The reference list becomes a trie of folded spellings. Every entry has one path for its name
and more for its aliases (other names, codes, names in other languages, abbreviated first
words), so an alias costs nothing. A typed value is folded and stripped of what people add to
a name (postal code, country, 'City of', brackets), and the trie is walked with the row of a
banded edit distance as the automaton's state: a subtree is left as soon as no cell of the row
is within the distance allowed for the value's length. All entries within that distance come
back; the nearest win, and ties are settled by the country beside the value.

A list of up to `limit` entries is shipped as a trie: the corpus is then never shuffled, matching is one
narrow Arrow-batched pass with a memo of values seen, which is what makes a value repeated in a third of the
rows cheap. A longer town list is joined instead (`match_joined`): distinct values meet the list's spellings by a
pigeonhole segment join, every pair is verified with the same distance, and the same rules decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactweave.llm.folding import damerau, fold
from contactweave.llm.segment_join import similar_pairs
from contactweave.session import bounded_rows
from contactweave.sources.readers import parsable

UNMATCHED = "UNMATCHED"
MAX_REFERENCE = 100_000
MEMO = 200_000

# ---------------------------------------------------------------- fixed values: country aliases
#: Names of the listed countries in German, French, Spanish and other use, and older codes.
COUNTRY_ALIASES = {
    "MT": "Malte; Malta Island; Republic of Malta",
    "DE": "Allemagne; Alemania; Deutschland; BRD; FRG; GER; Federal Republic of Germany; Germania; Duitsland",
    "FR": "Frankreich; Francia; Frankrijk; French Republic",
    "ES": "Spanien; Espagne; Spagna; Kingdom of Spain; Spanje",
    "GB": "UK; U.K.; Great Britain; Britain; England; Scotland; Wales; Northern Ireland; Grossbritannien; Vereinigtes Koenigreich; Vereinigtes Königreich; Royaume-Uni; Angleterre; Reino Unido; Regno Unito; Gran Bretagna; Gran Bretaña",
    "IT": "Italien; Italie; Italië; Italian Republic",
    "AT": "Autriche; Oesterreich; Oostenrijk; OE",
    "CH": "Suisse; Svizzera; Suiza; SUI; Swiss Confederation; Zwitserland",
    "NL": "Holland; The Netherlands; Niederlande; Pays-Bas; Países Bajos; Paesi Bassi; NED; HOL",
    "BE": "Belgien; België; Bélgica; Belgio",
    "PT": "Portugal (Continental); Portogallo; POR",
    "IE": "Irland; Irlande; Irlanda; Republic of Ireland; Rep. of Ireland; Eire; Ierland",
    "DK": "Dänemark; Danemark; Dinamarca; Danimarca; DEN; Denemarken",
    "SE": "Schweden; Suède; Suecia; Svezia; Zweden",
    "NO": "Norwegen; Norvège; Noruega; Norvegia; Noorwegen",
    "FI": "Finnland; Finlande; Finlandia",
    "PL": "Polen; Pologne; Polonia",
    "CZ": "Czech Republic; Czech Rep.; Tschechien; Tschechische Republik; Tchéquie; République tchèque; Chequia; República Checa; Česká republika",
    "SK": "Slowakei; Slovaquie; Eslovaquia; Slovak Republic; Slovacchia",
    "SI": "Slowenien; Slovénie; Eslovenia; SLO",
    "HU": "Ungarn; Hongrie; Hungría; Ungheria",
    "RO": "Rumänien; Roumanie; Rumania; Rumanía; ROM",
    "BG": "Bulgarien; Bulgarie; BUL",
    "GR": "Griechenland; Grèce; Grecia; Hellas; Hellenic Republic; GRE; EL",
    "HR": "Kroatien; Croatie; Croacia; CRO; Croazia",
    "CY": "Zypern; Chypre; Chipre; Cipro; Kibris",
    "EE": "Estland; Estonie",
    "LV": "Lettland; Lettonie; Letonia; LAT",
    "LT": "Litauen; Lituanie; Lituania",
    "LU": "Luxemburg; Luxemburgo; Lussemburgo; Grand Duchy of Luxembourg",
    "IS": "Islande; Islandia; Islanda; Island",
    "TR": "Türkei; Turquie; Turquía; Turchia; Turkiye; Republic of Turkey",
}

#: First words of town names that stand for one another (fixed values), folded.
TOWN_PREFIXES = (
    ("saint", "st", "st.", "sankt", "san", "santa", "s.", "s", "sainte", "ste", "sta", "sint"),
    ("port", "pt", "pt.", "puerto", "porto"),
    ("mount", "mt", "mt.", "mont", "monte"),
    ("upper", "ober", "up.", "upp.", "haut", "alto"),
    ("neu", "new", "nueva", "nouvelle", "nuova"),
    ("villa", "ville"),
    ("bad", "bain"),
)
#: Words people put before a town's name (fixed values), folded.
_BEFORE = re.compile(
    r"^(?:(?:city|town|village|municipality|stadt|gemeinde|commune|ville|ciudad|comune) (?:of|de|di|von)\b|greater|near|nr|nahe|pres de|cerca de|central|downtown|metro)\.?\s+"
)
_CODE = re.compile(r"^\d[\d ]*\b\s*|\s+\d[\d ]*$")
_COUNTRY_TAIL = re.compile(r"\s*(?:\(([^()]*)\)|[,/|]\s*([^,]*))\s*$")


def allowed_distance(n: int) -> int:
    """Edit distance allowed for a folded value of n letters."""
    return 0 if n < 4 else 1 if n < 8 else 2


class Trie:
    """Folded spellings with the reference keys that end there."""

    __slots__ = ("keys", "next")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.keys: set[str] = set()

    def add(self, spelling: str, key: str) -> None:
        node = self
        for c in spelling:
            node = node.next.setdefault(c, Trie())
        node.keys.add(key)

    def search(self, value: str, limit: int) -> dict[str, int]:
        """Every key within `limit` edits (a swap of neighbours is one), with its least distance."""
        found: dict[str, int] = {}
        first = [j if j <= limit else limit + 1 for j in range(len(value) + 1)]
        for c, node in self.next.items():
            self._walk(node, c, "", value, 1, first, None, limit, found)
        return found

    def _walk(self, node, c, last, value, depth, prev, before, limit, found) -> None:
        """One letter down: only cells within `limit` of the diagonal can count, all others are too far."""
        n, big = len(value), limit + 1
        row = [big] * (n + 1)
        low, high = max(1, depth - limit), min(n, depth + limit)
        least = row[0] = depth if depth <= limit else big
        for j in range(low, high + 1):
            if value[j - 1] == c:
                d = prev[j - 1]
            else:
                d = prev[j] if prev[j] < prev[j - 1] else prev[j - 1]
                d = 1 + (d if d < row[j - 1] else row[j - 1])
            if before is not None and j > 1 and value[j - 2] == c and value[j - 1] == last and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            if d < big:
                row[j] = d
                if d < least:
                    least = d
        if node.keys and row[n] <= limit:
            for k in node.keys:
                if row[n] < found.get(k, big):
                    found[k] = row[n]
        if least <= limit or min(prev) < limit:
            for letter, child in node.next.items():
                self._walk(child, letter, c, value, depth + 1, row, prev, limit, found)


def squeeze(value: str) -> str:
    """Folded value with punctuation as single spaces."""
    return re.sub(r"[\s\-_.,;:'’\"/\\|()\[\]{}]+", " ", fold(value)).strip()


class Countries:
    """Country reference: codes match in any case, names and aliases by the automaton."""

    def __init__(self, rows: list[tuple]):
        self.codes: dict[str, str] = {}
        self.trie, self.alias_trie = Trie(), Trie()
        for code, name, iso3, native in rows:
            for spelling in (code, iso3):
                if spelling:
                    self.codes[squeeze(spelling).replace(" ", "")] = code
            aliases = [a.strip() for a in COUNTRY_ALIASES.get(code, "").split(";") if a.strip()]
            for trie, spellings in ((self.trie, (name, native)), (self.alias_trie, aliases)):
                for s in map(squeeze, filter(None, spellings)):
                    if len(s) <= 3:
                        self.codes.setdefault(s.replace(" ", ""), code)
                    else:
                        trie.add(s, code)

    def match(self, value: str | None) -> str | None:
        """Country code of a typed value, or None."""
        if value is None or not value.strip():
            return None
        whole = squeeze(value)
        got = self._one(whole)
        if got:
            return got
        parts = [p for p in re.split(r"\s+-\s+|[,;/|()\[\]]|-", value) if p.strip()]
        if len(parts) > 1:
            hits = {h for p in parts if (h := self._one(squeeze(p)))}
            if len(hits) == 1:
                return hits.pop()
        return None

    def _one(self, s: str) -> str | None:
        if not s:
            return None
        packed = s.replace(" ", "")
        if len(packed) <= 3:
            return self.codes.get(packed)
        limit = allowed_distance(len(s))
        # at one distance a listed name goes before an alias
        found = [(d, 0, k) for k, d in self.trie.search(s, limit).items()]
        found += [(d, 1, k) for k, d in self.alias_trie.search(s, limit).items()]
        if not found:
            return None
        nearest = {k for d, a, k in found if (d, a) == min(found)[:2]}
        return nearest.pop() if len(nearest) == 1 else None


class Towns:
    """Town reference: names, other names and abbreviated first words; the country settles ties."""

    def __init__(self, rows: list[tuple], countries: Countries):
        self.countries = countries
        self.trie = Trie()
        self.country: dict[str, str] = {}
        self.swap: dict[str, tuple[str, ...]] = {}
        for group in TOWN_PREFIXES:
            for w in group:
                self.swap[w] = group
        for key, name, alt, code in rows:
            self.country[key] = code
            for spelling in (name, alt):
                if spelling:
                    for path in self._paths(squeeze(spelling)):
                        self.trie.add(path, key)
        self.exact = {}
        for key, name, alt, code in rows:
            for spelling in (name, alt):
                if spelling:
                    self.exact.setdefault(squeeze(spelling), set()).add(key)

    def _paths(self, s: str) -> set[str]:
        head, _, rest = s.partition(" ")
        paths = {s}
        if rest and head in self.swap:
            paths |= {f"{w.rstrip('.')} {rest}" for w in self.swap[head]} | {f"{w.rstrip('.')}{rest}" for w in self.swap[head]}
        return paths

    def match(self, value: str | None, country: str | None = None) -> tuple[str | None, list[str]]:
        """(reference key or None, all nearest candidates). `country`: as typed beside the value."""
        s, code = self.spelling(value, country)
        return self._nearest(s, code) if s else (None, [])

    def spelling(self, value: str | None, country: str | None) -> tuple[str, str | None]:
        """(folded spelling without what people add to a name, country code beside or behind it)."""
        if value is None or not value.strip():
            return "", None
        code = self.countries.match(country)
        tail_code, plain = None, value
        m = _COUNTRY_TAIL.search(plain)
        if m and m.start() > 0:
            tail_code = self.countries.match(m[1] or m[2])
            if tail_code or m[1] is not None:
                plain = plain[: m.start()]
        s = _CODE.sub("", squeeze(plain)).strip()
        for _ in range(2):
            s = _BEFORE.sub("", s)
        return s, code or tail_code

    def within(self, value: str | None, country: str | None = None) -> list[tuple[str, int]]:
        """All entries within the distance allowed for the value, nearest first, with their distances."""
        s, _code = self.spelling(value, country)
        found = self.trie.search(s, allowed_distance(len(s))) if s else {}
        return sorted(found.items(), key=lambda x: (x[1], x[0]))

    def _nearest(self, s: str, code: str | None) -> tuple[str | None, list[str]]:
        exact = self.exact.get(s)
        found = dict.fromkeys(exact, 0) if exact else self.trie.search(s, allowed_distance(len(s)))
        if not found:
            return None, []
        least = min(found.values())
        nearest = sorted(k for k, d in found.items() if d == least)
        if code:
            here = {k: d for k, d in found.items() if self.country[k] == code}
            if here:
                low = min(here.values())
                best = sorted(k for k, d in here.items() if d == low)
                return (best[0] if len(best) == 1 else None), best
            if least > 0:  # a misspelling of a town in another country is no evidence
                return None, nearest
        return (nearest[0] if len(nearest) == 1 else None), nearest


def load_countries(country_ref: DataFrame, limit: int = MAX_REFERENCE) -> list[tuple]:
    rows = bounded_rows(country_ref.select("country_code", "country_name", "iso3", "native_name"), limit, "country reference")
    return [tuple(r) for r in rows if r[0] is not None]


def load_towns(city_ref: DataFrame, limit: int = MAX_REFERENCE) -> list[tuple]:
    rows = bounded_rows(city_ref.select("city_key", "city_name", "alt_name", "country_code"), limit, "town reference")
    return [tuple(r) for r in rows if r[0] is not None]


class _Memo(dict):
    """Dictionary that starts afresh at its bound."""

    def put(self, key, value):
        if len(self) >= MEMO:
            self.clear()
        self[key] = value
        return value


def country_udf(countries: list[tuple]):
    """`typed value -> country_code` (null: no entry)."""

    @F.pandas_udf(T.StringType())
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ref, memo = Countries(countries), _Memo()
        for s in values:
            yield pd.Series([memo[v] if v in memo else memo.put(v, ref.match(v)) for v in s], dtype=object)

    return run.asNondeterministic()


def town_udf(towns: list[tuple], countries: list[tuple]):
    """`(typed town, typed country) -> city_key` (null: no entry, or not decidable)."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ref, memo = Towns(towns, Countries(countries)), _Memo()
        for values, beside in batches:
            out = []
            for k in zip(values, beside):
                out.append(memo[k] if k in memo else memo.put(k, ref.match(*k)[0]))
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()


#: Part of the JSON of the source table that the address operators read.
ADDRESS_SCHEMA = (
    "complete_address struct<borough:string,street:string,city:string,postal_code:string,state:string,country:string>,"
    " title string, address string"
)


def parsed_results(results: DataFrame) -> DataFrame:
    """`id` and the parsed `data` of records whose JSON parses as a whole; others are left out."""
    return parsable(results).select("id", F.from_json("data", ADDRESS_SCHEMA).alias("j"))


def candidates_udf(towns: list[tuple], countries: list[tuple]):
    """`(typed town, typed country) -> array<struct<ref_key, distance>>`, nearest first."""

    @F.pandas_udf("array<struct<ref_key:string,distance:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ref, memo = Towns(towns, Countries(countries)), _Memo()
        for values, beside in batches:
            out = []
            for k in zip(values, beside):
                out.append(memo[k] if k in memo else memo.put(k, [{"ref_key": e, "distance": d} for e, d in ref.within(*k)]))
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()


def spelling_udf(countries: list[tuple]):
    """`(typed town, typed country) -> struct<spelling, code>`."""

    @F.pandas_udf("struct<spelling:string,code:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ref = Towns([], Countries(countries))
        for values, beside in batches:
            yield pd.DataFrame([ref.spelling(*k) for k in zip(values, beside)], columns=["spelling", "code"])

    return run.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def paths_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All spellings under which a listed name is looked up, its own first."""
    for s in values:
        ref = Towns([], Countries([]))
        yield s.map(lambda v: [squeeze(v), *sorted(ref._paths(squeeze(v)) - {squeeze(v)})] if v else [])


@F.pandas_udf(T.IntegerType())
def distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits between a value and a spelling (a swap is one), -1 beyond what the value's length allows."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b):
            limit = allowed_distance(len(x))
            d = damerau(x, y, limit)
            out.append(d if d <= limit else -1)
        yield pd.Series(out)


def match_joined(typed: DataFrame, city_ref: DataFrame, country_ref: DataFrame) -> DataFrame:
    """(typed, beside, ref_key or null) for the distinct (typed, beside) of `typed`, the list joined as a table.

    The same candidates and rules as `Towns.match`: exact spellings shut out others, the nearest wins, the country
    beside the value settles ties, and a misspelling counts only in that country.
    """
    asked = typed.select("typed", "beside").distinct()
    asked = asked.select("typed", "beside", spelling_udf(load_countries(country_ref))("typed", "beside").alias("s")).select("typed", "beside", "s.spelling", "s.code").filter("spelling <> ''")
    refs = city_ref.filter("city_key IS NOT NULL").select(F.col("city_key").alias("ref_key"), F.col("country_code").alias("land"), F.explode(F.array("city_name", "alt_name")).alias("name")).filter("name <> ''")
    refs = refs.select("ref_key", "land", F.posexplode(paths_udf("name")).alias("at", "path")).groupBy("ref_key", "land", "path").agg(F.min("at").alias("at"))
    values = asked.select(F.lit("*").alias("block"), F.col("spelling").alias("text")).distinct()
    # a swap of neighbours is two plain edits, so the join looks twice as far as the distance goes
    near = similar_pairs(refs.select(F.lit("*").alias("block"), F.col("path").alias("text")).distinct(), values, ladder=((6, 4), (3, 2)))
    near = near.select(F.col("b").alias("spelling"), F.col("a").alias("path"), distance_udf("b", "a").alias("d")).filter("d >= 0")
    near = near.unionByName(values.select(F.col("text").alias("spelling"), F.col("text").alias("path"), F.lit(0).alias("d")))
    found = near.join(refs, "path").groupBy("spelling", "ref_key", "land").agg(F.min("d").alias("d"), F.max((F.col("d") == 0) & (F.col("at") == 0)).alias("exact"))
    shut = found.groupBy("spelling").agg(F.max("exact").alias("shut"))
    found = found.join(shut, "spelling").filter(~F.col("shut") | F.col("exact"))
    hits = asked.join(found, "spelling").withColumn("inside", F.col("land") == F.col("code"))
    per = hits.groupBy("typed", "beside", "code", "spelling").agg(F.min("d").alias("least"), F.min(F.when(F.col("inside"), F.col("d"))).alias("low"))
    keys = ["typed", "beside"]
    j = hits.join(per.select(F.col("typed").alias("t"), F.col("beside").alias("k"), "least", "low"), F.col("typed").eqNullSafe(F.col("t")) & F.col("beside").eqNullSafe(F.col("k")))
    elsewhere = (F.col("d") == F.col("least")) & (F.col("code").isNull() | (F.col("least") == 0))
    wanted = F.when(F.col("low").isNotNull(), F.col("inside") & (F.col("d") == F.col("low"))).otherwise(elsewhere)
    top = j.filter(wanted).groupBy(*keys).agg(F.countDistinct("ref_key").alias("n"), F.min("ref_key").alias("ref_key"))
    return top.select(*keys, F.when(F.col("n") == 1, F.col("ref_key")).alias("ref_key"))


def town_candidates(results: DataFrame, city_ref: DataFrame, country_ref: DataFrame) -> DataFrame:
    """rec_id, typed, ref_key, distance: every entry within the distance of every town that is not spelled as listed."""
    towns, countries = load_towns(city_ref), load_countries(country_ref)
    typed = typed_towns(results, city_ref)
    return typed.select("rec_id", "typed", F.explode(candidates_udf(towns, countries)("typed", "beside")).alias("c")).select("rec_id", "typed", "c.ref_key", "c.distance")


def typed_towns(results: DataFrame, city_ref: DataFrame) -> DataFrame:
    """rec_id, typed, beside of records whose typed town differs from every listed name."""
    names = city_ref.select(F.col("city_name").alias("__name")).distinct()
    town = F.col("j.complete_address.city")
    return (
        parsed_results(results)
        .select(F.col("id").alias("rec_id"), town.alias("typed"), F.col("j.complete_address.country").alias("beside"))
        .filter(F.col("typed").isNotNull() & (F.trim(F.regexp_replace("typed", r"\s+", " ")) != ""))
        .join(names, F.col("typed") == F.col("__name"), "left_anti")
        .drop("__name")
    )


def map_towns(results: DataFrame, city_ref: DataFrame, country_ref: DataFrame, limit: int = MAX_REFERENCE) -> DataFrame:
    """Records whose typed town differs from every listed name: rec_id, typed, ref_key or UNMATCHED.

    A list of more than `limit` entries is joined instead of shipped, with the same result.
    """
    typed = typed_towns(results, city_ref)
    if city_ref.limit(limit + 1).count() > limit:
        got = match_joined(typed, city_ref, country_ref).select(F.col("typed").alias("t"), F.col("beside").alias("k"), "ref_key")
        joined = typed.join(got, F.col("typed").eqNullSafe(F.col("t")) & F.col("beside").eqNullSafe(F.col("k")), "left")
        return joined.select("rec_id", "typed", F.coalesce("ref_key", F.lit(UNMATCHED)).alias("ref_key"))
    udf = town_udf(load_towns(city_ref, limit), load_countries(country_ref))
    return typed.select("rec_id", "typed", F.coalesce(udf("typed", "beside"), F.lit(UNMATCHED)).alias("ref_key"))


def map_countries(contacts: DataFrame, country_ref: DataFrame, placeholder: str = "XX") -> DataFrame:
    """Records whose typed country differs from every listed code: rec_id, typed, ref_key or UNMATCHED."""
    countries = load_countries(country_ref)
    code = F.col("country_code")
    typed = contacts.select(F.col("id").alias("rec_id"), code.alias("typed")).filter(
        F.col("typed").isNotNull()
        & (F.trim(F.regexp_replace("typed", r"\s+", " ")) != "")
        & ~F.col("typed").isin([c[0] for c in countries] + [placeholder])
    )
    return typed.select("rec_id", "typed", F.coalesce(country_udf(countries)("typed"), F.lit(UNMATCHED)).alias("ref_key"))
