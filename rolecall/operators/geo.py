"""Reading places from text. Distinct strings are read once, through joins with the place names, and joined back.

A wrong country is worse than none: a name that could be two places stays unread.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX, vocab as V
from ..sources.gazetteer import SUBDIVISIONS, Gazetteer
from .keyed import computed

_PLACE = "struct<city:string,region:string,country:string>"


def _none() -> Column:
    return F.lit(None).cast("string")


def _code_name(code: Column, country: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUBDIVISIONS[country].items() for x in pair])
    return F.try_element_at(table, code)


def subdivision_name(country: Column, code: Column) -> Column:
    """'California' for US and CA; NULL where the country has no such code."""
    upper = F.upper(code)
    return F.when(country == "US", _code_name(upper, "US")).when(country == "CA", _code_name(upper, "CA"))


def is_subdivision_code(code: Column) -> Column:
    return F.coalesce(code.isin([c for table in SUBDIVISIONS.values() for c in table]), F.lit(False))


def _is_code(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^\p{Lu}{2}$"), F.lit(False))


def _lookup(df: DataFrame, gazetteer: Gazetteer, key: Column, prefix: str) -> DataFrame:
    """Left join of the place names on a folded text; the hit's columns get the prefix."""
    names = gazetteer.places.select(F.col("name_key").alias(f"{prefix}_key"),
                                    *[F.col(c).alias(f"{prefix}_{c}") for c in ("iso", "sub_country", "sub_name", "entries")])
    return df.join(names, key == F.col(f"{prefix}_key"), "left").drop(f"{prefix}_key")


def country_of(value: Column, folded_iso: Column, codes: list[str]) -> Column:
    """ISO code of a feed's country text, given the name lookup's answer for its folded form."""
    text = F.trim(value)
    return (F.when((F.length(text) == 2) & F.upper(text).isin(codes), F.upper(text))
            .when(TX.fold(text).isin(V.NEEDS_CITY), _none()).otherwise(folded_iso))


def normalize_countries(df: DataFrame, gazetteer: Gazetteer, column: str, into: str) -> DataFrame:
    """Country text (code, name or alias) -> ISO code or NULL."""
    work = computed(df, __fold=TX.fold(F.trim(column)))
    hit = _lookup(work, gazetteer, F.col("__fold"), "__c")
    return (hit.withColumn(into, country_of(F.col(column), F.col("__c_iso"), list(gazetteer.countries)))
            .select(*df.columns, into))


def normalize_regions(df: DataFrame, gazetteer: Gazetteer, region: str, country: str, into: str) -> DataFrame:
    """Region text -> full name when it is a code or name of that country, else the text as given."""
    work = computed(df, __text=TX.clean(F.col(region)))
    hit = _lookup(computed(work, __fold=TX.fold(F.col("__text"))), gazetteer, F.col("__fold"), "__r")
    by_code = F.when(F.length("__text") <= 3, subdivision_name(F.col(country), F.col("__text")))
    agrees = F.col(country).isNull() | (F.col("__r_sub_country") == F.col(country))
    return (hit.withColumn(into, F.coalesce(by_code, F.when(agrees, F.col("__r_sub_name")), F.col("__text")))
            .select(*[c for c in df.columns if c != into], into))


# ---- free text ----

def split_places(texts: DataFrame, column: str) -> DataFrame:
    """Each text's segments: text, seg (position), whole (the segment without workplace words), tokens (the last three)."""
    segments = texts.select(F.col(column).alias("text"), F.posexplode(F.split(column, V.PLACE_SEGMENTS)).alias("seg", "raw"))
    bare = F.regexp_replace(F.regexp_replace("raw", V.PLACE_MORE, " "), V.PLACE_WORKPLACE_WORDS, " ")

    def token(raw: Column) -> Column:
        stripped = F.btrim(raw, F.lit(" -–—."))
        return F.trim(F.regexp_replace(stripped, V.PLACE_FILLER, ""))

    work = computed(segments, bare=bare)
    tokens = F.filter(F.transform(F.split("bare", V.PLACE_TOKENS), token), lambda t: t != "")
    work = computed(work, tokens=tokens, whole=TX.fold(F.btrim("bare", F.lit(" -–—"))))
    return (work.withColumn("tokens", F.slice("tokens", F.greatest(F.size("tokens") - 2, F.lit(1)), 3))
            .filter(F.size("tokens") > 0).select("text", "seg", "whole", "tokens"))


def _compatible(entries: Column, country: Column, region: Column) -> Column:
    return F.filter(entries, lambda e: (country.isNull() | (e["country"] == country))
                    & (region.isNull() | e["region"].isNull() | (e["region"] == region)))


def _one_city(entries: Column) -> Column:
    """All entries name one and the same city."""
    return F.coalesce((F.size(entries) > 0) & (F.size(F.array_distinct(F.transform(
        entries, lambda e: F.struct(e["name"].alias("n"), e["country"].alias("c"))))) == 1), F.lit(False))


def _any(entries: Column, test) -> Column:
    return F.coalesce(F.exists(entries, test), F.lit(False))


def read_places(texts: DataFrame, column: str, gazetteer: Gazetteer) -> DataFrame:
    """Distinct texts -> text, city, region, country: the first segment that can be read; unread texts have no row."""
    codes = list(gazetteer.countries)
    parts = split_places(texts.select(column).filter(F.col(column).isNotNull()).distinct(), column)
    n = F.size("tokens")
    df = computed(parts, n=n, first=F.col("tokens")[0], tail=F.element_at("tokens", -1),
                  middle=F.when(n == 3, F.col("tokens")[1]))
    df = computed(df, first_key=TX.fold(F.col("first")), tail_key=TX.fold(F.col("tail")), middle_key=TX.fold(F.col("middle")))
    df = _lookup(df, gazetteer, F.col("whole"), "w")
    df = _lookup(df, gazetteer, F.col("first_key"), "a")
    df = _lookup(df, gazetteer, F.col("tail_key"), "t")
    df = _lookup(df, gazetteer, F.col("middle_key"), "m")
    # the token before the last one, and the one after the first: with two tokens these are the first and the last
    three = F.col("n") == 3
    df = df.withColumns({
        "before": F.when(three, F.col("middle")).when(F.col("n") == 2, F.col("first")),
        "second": F.when(three, F.col("middle")).when(F.col("n") == 2, F.col("tail")),
        **{f"b_{c}": F.when(three, F.col(f"m_{c}")).when(F.col("n") == 2, F.col(f"a_{c}")) for c in ("sub_country", "sub_name")},
        **{f"s_{c}": F.when(three, F.col(f"m_{c}")).when(F.col("n") == 2, F.col(f"t_{c}")) for c in ("sub_country", "sub_name")}})

    # -- a city whose own name holds a comma
    named = F.filter("w_entries", lambda e: ~e["ambiguous"])
    whole = F.when(_one_city(named), F.struct(named[0]["name"].alias("city"), named[0]["region"].alias("region"),
                                              named[0]["country"].alias("country")))

    # -- the last token: a country, a subdivision, or nothing to rely on
    tail, multi, a = F.col("tail"), F.col("n") > 1, F.col("a_entries")
    df = computed(df, whole_place=whole, tail_code=_is_code(tail),
                  tail_us=_code_name(tail, "US"), tail_ca=_code_name(tail, "CA"), tail_iso=tail.isin(codes))
    sub_country = F.when(F.col("tail_us").isNotNull(), "US").when(F.col("tail_ca").isNotNull(), "CA")
    sub_name = F.coalesce("tail_us", "tail_ca")
    has_sub = F.col("tail_code") & sub_name.isNotNull()

    def found(country: Column, region: Column) -> Column:
        return F.struct(country.alias("country"), region.alias("region"), F.lit(1).alias("used"), F.lit(False).alias("refused"))

    def nothing(refused: bool) -> Column:
        return F.struct(_none().alias("country"), _none().alias("region"), F.lit(0).alias("used"), F.lit(refused).alias("refused"))

    in_georgia = _any(a, lambda e: (e["region"] == "Georgia") & (e["country"] == "US"))
    by_city_sub = _any(a, lambda e: (e["country"] == sub_country) & (e["region"] == sub_name))
    by_city_iso = _any(a, lambda e: e["country"] == F.col("tail"))
    several = (F.when(has_sub & ~F.col("tail_iso"), found(sub_country, sub_name))
               .when(has_sub & by_city_sub, found(sub_country, sub_name))
               .when(has_sub & by_city_iso, found(tail, _none()))
               .when(has_sub, nothing(True))
               .when(F.col("tail_iso"), found(tail, _none()))
               .when(F.col("t_iso").isNotNull(), found(F.col("t_iso"), _none()))
               .otherwise(nothing(False)))
    lone_code = ~multi & F.col("tail_code") & F.col("tail_iso") & sub_name.isNull()
    plain = (F.when(F.col("t_iso").isNotNull(), found(F.col("t_iso"), _none()))
             .when(lone_code, found(tail, _none()))
             .when(F.col("t_sub_name").isNotNull() & F.col("tail_key").isin(V.NEEDS_CONTEXT) & ~multi, nothing(True))
             .when(F.col("t_sub_name").isNotNull(), found(F.col("t_sub_country"), F.col("t_sub_name")))
             .otherwise(nothing(False)))
    georgia = F.when(multi & in_georgia, found(F.lit("US"), F.lit("Georgia"))).otherwise(nothing(True))
    df = computed(df, end=F.when(F.col("tail_key").isin(V.NEEDS_CITY), georgia)
                  .when(F.col("tail_code") & multi, several).otherwise(plain))

    # -- a subdivision before the country
    end = F.col("end")
    before_name = F.coalesce(F.when(_is_code(F.col("before")), subdivision_name(end["country"], F.col("before"))),
                             F.when(F.col("b_sub_country") == end["country"], F.col("b_sub_name")))
    looks = end["country"].isNotNull() & end["region"].isNull() & multi
    df = computed(df, inner_region=F.when(looks, before_name))
    df = computed(df, country0=end["country"], region0=F.coalesce(end["region"], F.col("inner_region")),
                  left=F.col("n") - end["used"] - F.when(F.col("inner_region").isNotNull(), 1).otherwise(0))

    # -- the city
    c0, r0, left = F.col("country0"), F.col("region0"), F.col("left")
    fits = _compatible(a, c0, r0)
    fits = F.when(c0.isNull() & r0.isNull(), F.filter(fits, lambda e: ~e["ambiguous"])).otherwise(fits)
    own = F.filter("t_entries", lambda e: (e["country"] == c0) & ~e["ambiguous"] & (TX.fold(e["name"]) == F.col("tail_key")))
    df = computed(df, fits=fits, own=own, tidy=TX.tidy_city(F.col("first")))
    entry, one = F.col("fits")[0], _one_city(F.col("fits"))
    city = (F.when((left == 0) & ~multi & c0.isNotNull(), F.try_element_at("own", F.lit(-1))["name"])
            .when((left > 0) & one, entry["name"]).when((left > 0) & c0.isNotNull(), F.col("tidy")))
    country = F.when((left > 0) & one, F.coalesce(c0, entry["country"])).otherwise(c0)
    lends = ~entry["ambiguous"] | ((country == entry["country"]) & (left == 1) & multi)
    region = F.when(r0.isNull() & (left > 0) & one & lends, entry["region"]).otherwise(r0)
    df = computed(df, forward=F.when(~end["refused"], F.struct(city.alias("city"), region.alias("region"),
                                                               country.alias("country"))))

    # -- country first
    first = F.col("first")
    lead = (F.when(F.col("first_key").isin(V.NEEDS_CITY), _none())
            .when(_is_code(first), F.when(first.isin(codes) & ~is_subdivision_code(first), first))
            .otherwise(F.col("a_iso")))
    df = computed(df, lead=F.when(multi, lead))
    lead_region = F.coalesce(F.when(_is_code(F.col("second")), subdivision_name(F.col("lead"), F.col("second"))),
                             F.when(F.col("s_sub_country") == F.col("lead"), F.col("s_sub_name")))
    df = computed(df, lead_region=lead_region, tidy_tail=TX.tidy_city(tail))
    behind = F.col("n") - 1 - F.when(F.col("lead_region").isNotNull(), 1).otherwise(0)
    near = _compatible(F.col("t_entries"), F.col("lead"), F.col("lead_region"))
    df = computed(df, near=near)
    same = F.coalesce((F.size("near") > 0) & (F.size(F.array_distinct(F.transform("near", lambda e: e["name"]))) == 1), F.lit(False))
    back_city = F.when(behind > 0, F.when(same, F.col("near")[0]["name"]).otherwise(F.col("tidy_tail")))
    backward = F.when(F.col("lead").isNotNull(), F.struct(back_city.alias("city"), F.col("lead_region").alias("region"),
                                                          F.col("lead").alias("country")))

    def real(place: Column) -> Column:
        return F.when(F.coalesce(place["city"], place["region"], place["country"]).isNotNull(), place.cast(_PLACE))

    read = df.select("text", "seg", F.coalesce(F.col("whole_place").cast(_PLACE), real(F.col("forward")), real(backward))
                     .alias("place")).filter(F.col("place").isNotNull())
    return read.groupBy("text").agg(F.min_by("place", "seg").alias("place")).select("text", "place.*")


HOT_ROWS = 100_000  # a text of more rows is spread over keys of its own, so many rows each
HOT_TEXTS = 10_000  # so many of the most frequent texts at most
HOT_LENGTH = 1000   # in characters; a longer text is never spread, which bounds what is broadcast


def _join_read(df: DataFrame, column: str, gazetteer: Gazetteer, wanted: Column | None = None) -> DataFrame:
    """Add __place, the place read from the text of `column` (NULL where none is, or where the row is not `wanted`).

    Texts are counted and read once each. A frequent text, read or not, is spread over several keys; rows that need no
    place are spread evenly. So no task gets more than some HOT_ROWS rows of one text.
    """
    own = F.col(column) if wanted is None else F.when(wanted, F.col(column))
    counts = df.select(own.alias("__text")).filter(F.col("__text").isNotNull()).groupBy("__text").agg(F.count("*").alias("__n"))
    hot = (counts.filter((F.col("__n") > HOT_ROWS) & (F.length("__text") <= HOT_LENGTH)).orderBy(F.desc("__n"), "__text").limit(HOT_TEXTS)
           .select(F.col("__text").alias("__hot"), (F.floor(F.col("__n") / HOT_ROWS) + 1).alias("__keys")))
    places = read_places(counts, "__text", gazetteer).select(F.col("text").alias("__text"), F.struct("city", "region", "country").alias("__place"))
    places = (places.join(F.broadcast(hot), F.col("__text") == F.col("__hot"), "left")
              .select("__text", "__place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__keys", F.lit(1)) - 1)).alias("__key")))
    marked = df.withColumn("__own", own).join(F.broadcast(hot), F.col("__own") == F.col("__hot"), "left")
    row = F.monotonically_increasing_id()
    # -1 and below: a key that no place has
    marked = marked.select(*df.columns, F.coalesce("__own", F.lit("")).alias("__text"),
                           F.when(F.col("__own").isNull(), -1 - row).otherwise(row % F.coalesce("__keys", F.lit(1))).alias("__key"))
    return marked.join(places, ["__key", "__text"], "left").select(*df.columns, "__place")


def add_places(df: DataFrame, gazetteer: Gazetteer, location: str = "location", city: str = "city", region: str = "region",
               country: str = "country") -> DataFrame:
    """Feed structure first, location text for what the feed left out unless it contradicts: adds geo_confidence."""
    work = df.withColumnsRenamed({city: "__city", region: "__region", country: "__country"})
    work = normalize_countries(work, gazetteer, "__country", "__iso")
    work = normalize_regions(work, gazetteer, "__region", "__iso", "__reg")
    work = computed(work, __town=TX.clean(F.col("__city"))).drop("__city", "__region", "__country")
    hit = _join_read(work, location, gazetteer).select("*", F.col("__place.city").alias("__pc"), F.col("__place.region").alias("__pr"),
                                                       F.col("__place.country").alias("__pi"))
    feed = F.coalesce("__iso", "__reg", "__town").isNotNull()
    agrees = F.col("__pi").isNull() | F.col("__iso").isNull() | (F.col("__pi") == F.col("__iso"))

    def filled(own: str, read: str) -> Column:
        return F.when(feed & ~agrees, F.col(own)).when(feed, F.coalesce(own, read)).otherwise(F.col(read))

    confidence = F.when(feed, "feed").when(F.col("__place").isNotNull(), "parsed")
    return hit.select(*[c for c in df.columns if c not in (city, region, country, "geo_confidence")],
                      filled("__town", "__pc").alias(city), filled("__reg", "__pr").alias(region),
                      filled("__iso", "__pi").alias(country), confidence.alias("geo_confidence"))


def backfill_places(postings: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Read places for stored rows that have none yet; rows with a confidence are left as they are."""
    hit = _join_read(postings, "location", gazetteer, F.col("geo_confidence").isNull())
    new = F.col("__place").isNotNull()
    return hit.select(*[
        F.when(new, F.col(source)).otherwise(F.col(c)).alias(c) if source else F.col(c)
        for c in postings.columns
        for source in [{"city": "__place.city", "region": "__place.region", "country": "__place.country"}.get(c)]
        if c != "geo_confidence"],
        F.when(new, "parsed").otherwise(F.col("geo_confidence")).alias("geo_confidence"))
