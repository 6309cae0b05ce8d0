"""Place dimensions: countries, US and Canadian subdivisions, cities, metro areas, region groups.

Countries (ISO 3166) and cities stand in the two files beside this one; a table of the caller's own (name, region, country,
aliases, ambiguous) replaces the cities through `Gazetteer.load(spark, cities=...)`. A city is ambiguous when its name
alone could be elsewhere.
"""
from __future__ import annotations

import csv
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import vocab as V
from ..functions.text import fold, fold_text
from ..operators.keyed import with_known_size

# Further names of a country.
COUNTRY_ALIASES = {
    "AE": ["UAE", "U.A.E.", "Emirates"], "AT": ["Österreich"], "AX": ["Aland Islands"], "BA": ["Bosnia"],
    "BE": ["België", "Belgique"], "BL": ["Saint Barthelemy"], "BN": ["Brunei Darussalam"], "BR": ["Brasil"],
    "BS": ["The Bahamas"], "CD": ["DR Congo", "DRC", "Congo (Kinshasa)"], "CG": ["Congo (Brazzaville)"],
    "CH": ["Schweiz", "Suisse"], "CI": ["Cote d'Ivoire", "Ivory Coast"],
    "CN": ["People's Republic of China", "PRC", "Mainland China"], "CV": ["Cape Verde"], "CW": ["Curacao"],
    "CZ": ["Czech Republic"], "DE": ["Deutschland"], "DK": ["Danmark"], "ES": ["España"], "FI": ["Suomi"],
    "GB": ["UK", "U.K.", "Great Britain", "GB", "Britain", "England", "Scotland", "Wales", "Northern Ireland"],
    "GM": ["The Gambia"], "HK": ["Hong Kong SAR"], "IE": ["Republic of Ireland"], "IT": ["Italia"],
    "KR": ["Korea", "Republic of Korea", "Korea, Republic of"], "MK": ["Macedonia"], "MM": ["Burma"], "MO": ["Macau"],
    "MX": ["México"], "NL": ["The Netherlands", "Holland", "Nederland"], "NO": ["Norge"], "PH": ["The Philippines"],
    "PL": ["Polska"], "PS": ["State of Palestine"], "RE": ["Reunion"], "RU": ["Russian Federation"], "SA": ["KSA"],
    "SE": ["Sverige"], "ST": ["Sao Tome and Principe"], "SZ": ["Swaziland"], "TL": ["East Timor"],
    "TR": ["Turkiye", "Turkey"], "US": ["USA", "U.S.", "U.S.A.", "United States of America", "America"],
    "VA": ["Holy See"], "VI": ["US Virgin Islands"], "VN": ["Viet Nam"]}

# Subdivisions read from addresses.
SUBDIVISIONS = {
    "US": {"AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
           "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
           "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
           "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
           "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
           "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
           "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
           "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
           "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
           "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming"},
    "CA": {"AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick",
           "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut",
           "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon"}}


def _rows(name: str) -> list[dict[str, str]]:
    with (Path(__file__).parent / name).open(encoding="utf-8", newline="") as lines:
        return list(csv.DictReader(lines))


@lru_cache(maxsize=1)
def built_in_cities() -> list[tuple[str, str | None, str, list[str], bool]]:
    """(name, region, country, aliases, ambiguous) of cities.csv."""
    return [(r["name"], r["region"] or None, r["country"], [a for a in r["aliases"].split("|") if a], r["ambiguous"] == "yes")
            for r in _rows("cities.csv")]


# Metro areas and the cities they stand for.
_BAY = ["San Francisco", "San Jose", "Oakland", "Palo Alto", "Mountain View", "Sunnyvale", "Menlo Park", "Redwood City",
        "South San Francisco", "Santa Clara", "Cupertino", "Fremont", "San Mateo", "Emeryville", "Berkeley", "Los Gatos",
        "Foster City", "Burlingame"]
METROS = {"Bay Area": _BAY, "SF Bay Area": _BAY, "San Francisco Bay Area": _BAY, "Silicon Valley": _BAY}

# Region groups. Those without a label are building blocks only.
REGION_GROUPS = {
    "EUROPE": {"countries": [
            "AD", "AL", "AT", "AX", "BA", "BE", "BG", "BY", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FO",
            "FR", "GB", "GG", "GI", "GR", "HR", "HU", "IE", "IM", "IS", "IT", "JE", "LI", "LT", "LU", "LV", "MC",
            "MD", "ME", "MK", "MT", "NL", "NO", "PL", "PT", "RO", "RS", "RU", "SE", "SI", "SJ", "SK", "SM", "UA",
            "VA", "XK"]},
    "MIDDLE_EAST": {"countries": ["AE", "BH", "EG", "IL", "IQ", "IR", "JO", "KW", "LB", "OM", "PS", "QA", "SA", "SY", "TR", "YE"]},
    "AFRICA": {"countries": [
            "AO", "BF", "BI", "BJ", "BW", "CD", "CF", "CG", "CI", "CM", "CV", "DJ", "DZ", "EH", "ER", "ET", "GA",
            "GH", "GM", "GN", "GQ", "GW", "KE", "KM", "LR", "LS", "LY", "MA", "MG", "ML", "MR", "MU", "MW", "MZ",
            "NA", "NE", "NG", "RE", "RW", "SC", "SD", "SH", "SL", "SN", "SO", "SS", "ST", "SZ", "TD", "TG", "TN",
            "TZ", "UG", "YT", "ZA", "ZM", "ZW"]},
    "ASIA_PACIFIC": {"countries": [
            "AF", "AS", "AU", "BD", "BN", "BT", "CK", "CN", "FJ", "FM", "GU", "HK", "ID", "IN", "JP", "KG", "KH",
            "KI", "KP", "KR", "KZ", "LA", "LK", "MH", "MM", "MN", "MO", "MP", "MV", "MY", "NC", "NP", "NR", "NZ",
            "PF", "PG", "PH", "PK", "PW", "SB", "SG", "TH", "TJ", "TL", "TM", "TO", "TV", "TW", "UZ", "VN", "VU",
            "WS"]},
    "LATIN_AMERICA": {"countries": [
            "AG", "AI", "AR", "AW", "BB", "BL", "BM", "BO", "BQ", "BR", "BS", "BZ", "CL", "CO", "CR", "CU", "CW",
            "DM", "DO", "EC", "FK", "GD", "GF", "GP", "GT", "GY", "HN", "HT", "JM", "KN", "KY", "LC", "MF", "MQ",
            "MS", "MX", "NI", "PA", "PE", "PR", "PY", "SR", "SV", "SX", "TC", "TT", "UY", "VC", "VE", "VG", "VI"]},
    "NORTH_AMERICA": {"countries": ["CA", "US"]},
    "EMEA": {"label": "Europe, Middle East & Africa", "aliases": ["EMEA"], "includes": ["EUROPE", "MIDDLE_EAST", "AFRICA"]},
    "APAC": {"label": "Asia-Pacific", "aliases": ["APAC", "Asia Pacific", "Asia-Pacific", "APJ"],
             "includes": ["ASIA_PACIFIC"]},
    "LATAM": {"label": "Latin America", "aliases": ["LATAM", "LatAm", "Latin America"], "includes": ["LATIN_AMERICA"]},
    "NORAM": {"label": "North America", "aliases": ["NORAM", "North America", "NAM"], "includes": ["NORTH_AMERICA"]},
    "AMERICAS": {"label": "The Americas", "aliases": ["Americas", "The Americas"],
                 "includes": ["NORTH_AMERICA", "LATIN_AMERICA"]},
    "EU": {"label": "European Union", "aliases": ["EU", "European Union"],
           "countries": [
            "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT",
            "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"]},
    "DACH": {"label": "Germany, Austria & Switzerland", "aliases": ["DACH"], "countries": ["DE", "AT", "CH"]},
    "NORDICS": {"label": "Nordic countries", "aliases": ["Nordics", "Nordic", "Scandinavia"],
                "countries": ["DK", "FI", "IS", "NO", "SE"]},
    "UKI": {"label": "United Kingdom & Ireland", "aliases": ["UK&I", "UKI", "UK & Ireland", "UK and Ireland"],
            "countries": ["GB", "IE"]},
    "ANZ": {"label": "Australia & New Zealand", "aliases": ["ANZ"], "countries": ["AU", "NZ"]},
    "MENA": {"label": "Middle East & North Africa", "aliases": ["MENA"],
             "countries": [
            "AE", "BH", "DZ", "EG", "EH", "IL", "IQ", "IR", "JO", "KW", "LB", "LY", "MA", "MR", "OM", "PS", "QA",
            "SA", "SD", "SY", "TN", "TR", "YE"]}}


@lru_cache(maxsize=1)
def iso_countries() -> dict[str, str]:
    """ISO code -> English name."""
    return {r["code"]: r["name"] for r in _rows("countries.csv")}


@dataclass(frozen=True)
class Gazetteer:
    """The dimensions as tables (for joins) and as small mappings (for filter arguments, never for data rows)."""

    spark: SparkSession
    countries: dict[str, str]
    own_cities: DataFrame | None = None
    groups: dict = field(default_factory=lambda: REGION_GROUPS)

    @classmethod
    def load(cls, spark: SparkSession, cities: DataFrame | None = None, countries: dict[str, str] | None = None) -> Gazetteer:
        return cls(spark, countries or iso_countries(), cities)

    # ---- tables ----

    def _table(self, rows: list[tuple], ddl: str) -> DataFrame:
        """A fixed list as a table that travels inside the plan."""
        schema = StructType.fromDDL(ddl)
        columns = {f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)}
        return self.spark.createDataFrame(pa.table(columns), schema=schema)

    @cached_property
    def country_names(self) -> DataFrame:
        """name_key -> iso; an earlier code's name wins."""
        return self._table(list(self._names.items()), "name_key STRING, iso STRING")

    @cached_property
    def country_list(self) -> DataFrame:
        rows = [(iso, name, fold_text(name)) for iso, name in self.countries.items()]
        return self._table(rows, "code STRING, name STRING, name_key STRING")

    @cached_property
    def subdivisions(self) -> DataFrame:
        rows = [(c, code, name, fold_text(name), rank) for rank, (c, table) in enumerate(SUBDIVISIONS.items())
                for code, name in table.items()]
        return self._table(rows, "country STRING, code STRING, name STRING, name_key STRING, priority INT")

    @cached_property
    def cities(self) -> DataFrame:
        if self.own_cities is not None:
            return self.own_cities.select("name", "region", "country", "aliases", "ambiguous")
        return self._table(built_in_cities(), "name STRING, region STRING, country STRING, aliases ARRAY<STRING>, ambiguous BOOLEAN")

    @cached_property
    def city_names(self) -> DataFrame:
        """name_key -> entries, the cities known under that name."""
        if self.own_cities is None:
            known: dict[str, list] = {}
            for name, region, country, aliases, ambiguous in built_in_cities():
                for key in dict.fromkeys(map(fold_text, [name, *aliases])):
                    known.setdefault(key, []).append(
                        {"name": name, "region": region, "country": country, "ambiguous": ambiguous})
            return self._table(list(known.items()), "name_key STRING, entries ARRAY<STRUCT<name: STRING, region: STRING, "
                                                    "country: STRING, ambiguous: BOOLEAN>>")
        labels = self.cities.select("*", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("label"))
        entry = F.struct("name", "region", "country", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
        return (labels.select(fold(F.col("label")).alias("name_key"), entry.alias("entry")).distinct()
                .groupBy("name_key").agg(F.array_sort(F.collect_list("entry")).alias("entries")))

    @cached_property
    def place_names(self) -> DataFrame:
        """One row per country or subdivision name: the country and the subdivision it can stand for."""
        subs = {fold_text(name): (country, name) for country, table in reversed(SUBDIVISIONS.items())
                for name in table.values()}
        rows = [(key, self._names.get(key), *subs.get(key, (None, None))) for key in {**self._names, **subs}]
        return self._table(rows, "name_key STRING, iso STRING, sub_country STRING, sub_name STRING")

    @cached_property
    def places(self) -> DataFrame:
        """One row per name: the country, subdivision and cities it can stand for.

        The built-in lists give some hundred rows and are always broadcast; a caller's city table is counted first.
        """
        if self.own_cities is not None:
            return with_known_size(self.place_names.join(self.city_names, "name_key", "full"))
        names = {r[0]: r for r in zip(*[c.to_pylist() for c in self.place_names.toArrow().columns])}
        cities = dict(zip(*[c.to_pylist() for c in self.city_names.toArrow().columns]))
        rows = [(*names.get(key, (key, None, None, None)), cities.get(key)) for key in {**names, **cities}]
        return F.broadcast(self._table(
            rows, "name_key STRING, iso STRING, sub_country STRING, sub_name STRING, entries ARRAY<STRUCT<name: STRING, "
                  "region: STRING, country: STRING, ambiguous: BOOLEAN>>"))

    # ---- small mappings for filter arguments ----

    @cached_property
    def _names(self) -> dict[str, str]:
        seen: dict[str, str] = {}
        for iso, name in self.countries.items():
            for alias in [name, *COUNTRY_ALIASES.get(iso, [])]:
                seen.setdefault(fold_text(alias), iso)
        return seen

    def country_code(self, value: str) -> str | None:
        text = value.strip()
        if len(text) == 2 and text.upper() in self.countries:
            return text.upper()
        key = fold_text(text)
        return None if key in V.NEEDS_CITY else self._names.get(key)

    def group_countries(self, key: str) -> list[str]:
        """All member countries, included groups at any depth counted once."""
        found, todo, seen = set(), [key], set()
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            entry = self.groups.get(name, {})
            found |= set(entry.get("countries", []))
            todo += entry.get("includes", [])
        return sorted(found)

    def group_aliases(self, key: str) -> list[str]:
        return list(self.groups.get(key, {}).get("aliases", [])) or [key]

    def find_group(self, text: str) -> str | None:
        key = fold_text(text)
        return next((name for name, entry in self.groups.items() if entry.get("label")
                     and key in {fold_text(name), *map(fold_text, entry.get("aliases", []))}), None)

    def group_members(self) -> DataFrame:
        """group, label, country: the closure over included groups as a table."""
        rows = [(k, e["label"], c) for k, e in self.groups.items() if e.get("label") for c in self.group_countries(k)]
        return self._table(rows, "region_group STRING, label STRING, country STRING")

    def group_alias_table(self) -> DataFrame:
        rows = [(k, a) for k, e in self.groups.items() if e.get("label") for a in self.group_aliases(k)]
        return self._table(rows, "region_group STRING, alias STRING")

    def expand(self, term: str) -> list[tuple[str | None, str]]:
        """What a search word also stands for, as (field or None, phrase), the word itself first."""
        out: list[tuple[str | None, str]] = [(None, term)]

        def add(column, phrase):
            if all((c, p.lower()) != (column, phrase.lower()) for c, p in out):
                out.append((column, phrase))

        key = fold_text(term)
        if not key:
            return out
        entries = self._city_entries(key)
        if len({name for name, _ in entries}) == 1:
            name, aliases = entries[0]
            for label in [name, *aliases]:
                if len(label) > 2 and "," not in label:
                    add(None, label)
        for metro, members in METROS.items():
            if fold_text(metro) == key:
                for city in members:
                    add(None, city)
        iso = None if key in V.NEEDS_CITY else self._names.get(key)
        if iso:
            add("country", iso)
            add(None, self.countries[iso])
        group = self.find_group(term)
        if group:
            for code in self.group_countries(group):
                add("country", code)
            for alias in self.group_aliases(group):
                add(None, alias)
        return out

    def _city_entries(self, key: str) -> list[tuple[str, list[str]]]:
        """Cities known under one folded name; one small lookup per search word when the table is the caller's."""
        if self.own_cities is None:
            return [(c[0], c[3]) for c in built_in_cities() if key in map(fold_text, [c[0], *c[3]])]
        labels = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array())), fold)
        hits = self.cities.filter(F.array_contains(labels, key)).select("name", "aliases").collect()     # the cities of one name
        return [(r.name, r.aliases or []) for r in hits]

    def is_known_place(self, text: str) -> bool:
        return len(self.expand(text)) > 1
