import pytest

from rolecall.operators import geo
from rolecall.operators.geo import add_places, backfill_places, normalize_countries, normalize_regions, read_places
from rolecall.sources.gazetteer import SUBDIVISIONS, Gazetteer, built_in_cities

# (text, city, region, country)
READ = {
    # a city with its state or province, long or short, with or without a country
    "Denver, CO": ("Denver", "Colorado", "US"),
    "Chicago, Illinois, US": ("Chicago", "Illinois", "US"),
    "Calgary, Alberta": ("Calgary", "Alberta", "CA"),
    "Ohio": (None, "Ohio", "US"),
    # a city or country alone, in any spelling
    "MÜNCHEN": ("Munich", None, "DE"),
    "Cracow": ("Krakow", None, "PL"),
    "Norway": (None, None, "NO"),
    # a city the list does not know, next to its country, before or after it
    "Porto, Portugal": ("Porto", None, "PT"),
    "Japan, Osaka": ("Osaka", None, "JP"),
    # a name many places share is read only with its country
    "Rome, Italy": ("Rome", None, "IT"),
    # wording around the place, and several places: the first counts
    "Japan, Osaka (+5 more)": ("Osaka", None, "JP"),
    "Hybrid | Madrid, Spain": ("Madrid", None, "ES"),
    "Remote - Norway": (None, None, "NO"),
    "Oslo; Stockholm": ("Oslo", None, "NO"),
    "Atlanta, Georgia, USA": ("Atlanta", "Georgia", "US"),
}
REFUSED = ["Rome", "Oxford", "Savannah, Georgia", "Somerville, IN", "MT", "Mars Base", "Worldwide", "Hybrid", "Floor 12", "3 Sites", "   "]


def test_places_read_and_refused(spark):
    texts = [(t,) for t in [*READ, *REFUSED]]
    rows = read_places(spark.createDataFrame(texts, "place STRING"), "place", Gazetteer.load(spark)).collect()
    got = {r.text: (r.city, r.region, r.country) for r in rows}
    wrong = {t: (got.get(t), want) for t, want in READ.items() if got.get(t) != want}
    assert wrong == {}
    assert {t: got[t] for t in REFUSED if t in got} == {}


def test_every_city_alone_is_read_unless_ambiguous(spark):
    g = Gazetteer.load(spark)
    known = {}
    for name, region, country, aliases, ambiguous in built_in_cities():
        for label in [name, *aliases]:
            known.setdefault(geo.TX.fold_text(label), []).append((label, (name, region, country), ambiguous))
    other = {geo.TX.fold_text(n) for n in ["New York", "Luxembourg", "DC", "LA"]}  # a state, a country, codes as well
    want = {label: place for key, ((label, place, ambiguous), *more) in known.items() if not more and not ambiguous and key not in other}
    vague = [label for (label, _, ambiguous), *_ in known.values() if ambiguous]
    rows = read_places(spark.createDataFrame([(t,) for t in [*want, *vague]], "place STRING"), "place", g).collect()
    got = {r.text: (r.city, r.region, r.country) for r in rows}
    assert len(want) > 200 and {t: got.get(t) for t in want if got.get(t) != want[t]} == {}
    assert [t for t in vague if t in got] == []
    regions = {(c, name) for c, table in SUBDIVISIONS.items() for name in table.values()}
    for name, region, country, *_ in built_in_cities():
        assert country in g.countries and (region is None or (country, region) in regions), name
        assert (region is not None) == (country in SUBDIVISIONS), name


@pytest.mark.parametrize("hot", [(1, 1), (10, 2), (100_000, 1000)])
def test_frequent_texts_are_joined_like_others(spark, monkeypatch, hot):
    monkeypatch.setattr(geo, "HOT_ROWS", hot[0])
    monkeypatch.setattr(geo, "HOT_TEXTS", hot[1])
    texts = ["Leeds"] * 50 + ["Remote"] * 40 + [None] * 30 + [""] * 20 + ["Osaka", "Mars Base", "x" * 3000, "Leeds, UK"]
    df = spark.createDataFrame([(i, t, "feed" if i % 7 == 0 else None) for i, t in enumerate(texts)], "id INT, location STRING, geo_confidence STRING")
    df = df.selectExpr("id", "location", "CAST(NULL AS STRING) AS city", "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS country", "geo_confidence")
    read = {"Leeds": ("Leeds", None, "GB", "parsed"), "Osaka": ("Osaka", None, "JP", "parsed"), "Leeds, UK": ("Leeds", None, "GB", "parsed")}
    none = (None, None, None, None)
    g = Gazetteer.load(spark)
    got = {r.id: (r.city, r.region, r.country, r.geo_confidence) for r in add_places(df, g).collect()}
    assert got == {i: read.get(t, none) for i, t in enumerate(texts)}
    got = {r.id: (r.city, r.region, r.country, r.geo_confidence) for r in backfill_places(df, g).collect()}
    assert got == {i: (None, None, None, "feed") if i % 7 == 0 else read.get(t, none) for i, t in enumerate(texts)}


def test_feed_structure_wins_and_text_fills_gaps(spark):
    rows = [(1, "Somewhere odd", "Lyon", "Rhône", "fr"), (2, "London, United Kingdom", None, None, "GB"),
            (3, "Berlin, Germany", None, None, "FR"), (4, "Austin, TX", None, None, None), (5, "Paris", None, None, None),
            (6, "Nowhere", "Gotham", None, "Atlantis"), (7, None, None, "CA", "United States")]
    df = spark.createDataFrame(rows, "id INT, location STRING, city STRING, region STRING, country STRING")
    got = {r.id: (r.city, r.region, r.country, r.geo_confidence) for r in add_places(df, Gazetteer.load(spark)).collect()}
    assert got == {1: ("Lyon", "Rhône", "FR", "feed"), 2: ("London", None, "GB", "feed"), 3: (None, None, "FR", "feed"),
                   4: ("Austin", "Texas", "US", "parsed"), 5: (None, None, None, None), 6: ("Gotham", None, None, "feed"),
                   7: (None, "California", "US", "feed")}


@pytest.mark.parametrize("value, iso", [("us", "US"), ("USA", "US"), ("U.S.A.", "US"), ("Georgia", None), ("GE", "GE"),
                                        ("españa", "ES"), ("Cote d'Ivoire", "CI"), ("Turkiye", "TR"), ("", None), ("zz", None)])
def test_country_code_of_filter_value(spark, value, iso):
    assert Gazetteer.load(spark).country_code(value) == iso


def test_country_and_region_columns(spark):
    df = spark.createDataFrame([("Deutschland", "BE"), ("us", "ca"), ("Canada", "Ontario"), ("GB", "  Kent "), (None, "TX")],
                               "c STRING, r STRING")
    g = Gazetteer.load(spark)
    got = normalize_regions(normalize_countries(df, g, "c", "iso"), g, "r", "iso", "region").select("iso", "region").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("DE", "BE"), ("US", "California"), ("CA", "Ontario"), ("GB", "Kent"), (None, "TX")], key=str)


def test_groups_and_expansion(spark):
    g = Gazetteer.load(spark)
    assert g.find_group("nordic") == "NORDICS" and g.find_group("EUROPE") is None
    assert "DE" in g.group_countries("EMEA") and "ZA" in g.group_countries("EMEA") and len(g.countries) == 250
    assert g.expand("nyc")[0] == (None, "nyc") and (None, "New York") in g.expand("nyc")
    assert ("country", "DE") in g.expand("germany") and (None, "Palo Alto") in g.expand("bay area")
    assert not g.is_known_place("engineer")
