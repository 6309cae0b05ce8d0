"""Queries over postings: filters, facets, search, sorting, geography.

The order tables play the postings: an order is a posting, its customer the company, the customer's nation the country.
"""
from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import functions as F

from ..functions import text as TX, vocab as V
from ..operators import filters as FL, geo as G, search as S
from ..operators.filters import JobFilter
from ..operators.search import Search
from ..sources.gazetteer import METROS, REGION_GROUPS, Gazetteer
from . import duck as D
from .registry import pick, query

col, lit = F.col, F.lit

NATION_CODES = ["DE", "US", "FR", "GB", "IN", "BR", "JP", "CA", "ES", "PL", "IE", "AU", "NZ", "CH", "AT", "NO", "SE", "MX",
                "ZA", "AE", "SG", "CN", "KR", "IT", None]
SOURCES = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "oracle", "json-ld"]
PLACES = ["", " / Remote - EMEA", " (Menu)", " / apac", " / Remote LatAm only", " DACHs"]

POSTINGS = f"""p AS (SELECT o_orderkey AS posting_id, 'c' || c_custkey AS domain, c_name AS company,
    o_orderpriority || ' ' || lower(c_mktsegment) AS title,
    n_name || {D.pick(PLACES, 'o_orderkey')} AS location,
    CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS department, o_orderdate AS posted,
    {D.pick(SOURCES, 'o_custkey')} AS source,
    CASE o_orderstatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'onsite' END AS workplace,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'full_time' WHEN '2' THEN 'part_time' WHEN '3' THEN 'contract' WHEN '5' THEN 'intern' END
      AS employment_type, {D.pick(NATION_CODES, 'c_nationkey')} AS country, NULL::VARCHAR AS city, r_name AS region,
    o_totalprice > 400000 AS is_new
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def postings(t):
    rank = F.substring("o_orderpriority", 1, 1)
    joined = (t.orders.join(t.customer, col("o_custkey") == col("c_custkey"))
              .join(t.nation, col("c_nationkey") == col("n_nationkey")).join(t.region, col("n_regionkey") == col("r_regionkey")))
    return joined.select(
        col("o_orderkey").alias("posting_id"), F.concat(lit("c"), col("c_custkey").cast("string")).alias("domain"),
        col("c_name").alias("company"), F.concat("o_orderpriority", lit(" "), F.lower("c_mktsegment")).alias("title"),
        F.concat("n_name", pick(PLACES, col("o_orderkey"))).alias("location"),
        F.when(col("c_custkey") % 7 > 0, col("c_mktsegment")).alias("department"), col("o_orderdate").alias("posted"),
        pick(SOURCES, col("o_custkey")).alias("source"),
        F.when(col("o_orderstatus") == "O", "remote").when(col("o_orderstatus") == "F", "onsite").alias("workplace"),
        F.when(rank == "1", "full_time").when(rank == "2", "part_time").when(rank == "3", "contract")
        .when(rank == "5", "intern").alias("employment_type"),
        pick(NATION_CODES, col("c_nationkey")).alias("country"), lit(None).cast("string").alias("city"),
        col("r_name").alias("region"), (col("o_totalprice") > 400000).alias("is_new"))


_GAZETTEERS: dict[int, Gazetteer] = {}


def gazetteer(spark) -> Gazetteer:
    """One gazetteer per session."""
    if getattr(_GAZETTEERS.get("newest"), "spark", None) is not spark:
        _GAZETTEERS["newest"] = Gazetteer.load(spark)
    return _GAZETTEERS["newest"]


def group_countries(*groups):
    out = set()
    for g in groups:
        e = REGION_GROUPS[g]
        out |= set(e.get("countries", [])) | set(group_countries(*e.get("includes", [])))
    return sorted(out)


# ---- filters ----

@query("unknown_filter", """
    SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE quality::VARCHAR IN ('1') OR quality IS NULL""")
def unknown_filter(t):
    """FLT-1: a value list where "unknown" also means NULL."""
    return (t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            .filter(FL.in_values(col("quality").cast("string"), ["1", "unknown"], nullable=True)))


@query("unknown_on_required_field", "SELECT doc_id FROM documents WHERE false")
def unknown_on_required_field(t):
    """FLT-1: only "unknown" on a field that is always known matches nothing."""
    return t.documents.filter(FL.in_values(col("source"), ["unknown"], nullable=False)).select("doc_id")


_F1 = JobFilter(workplace=["remote", "unknown"], employment_type=["full_time", "contract"], department=["machinery", "BUILDING"],
                source=["lever", "ashby", "workday"])
_W1 = ("(workplace = 'remote' OR workplace IS NULL) AND employment_type IN ('full_time', 'contract') "
       "AND lower(department) IN ('machinery', 'building') AND source IN ('lever', 'ashby', 'workday')")


@query("facet_filters", f"WITH {POSTINGS} SELECT posting_id, workplace, employment_type, department, source FROM p WHERE {_W1}")
def facet_filters(t):
    """FLT-2: facet filters ANDed."""
    return FL.apply_filter(postings(t), _F1, gazetteer(t.spark)).select(
        "posting_id", "workplace", "employment_type", "department", "source")


_F2 = JobFilter(country=["Germany", "unknown", "jp"], region_group=["LATAM", "nordics"])
_W2 = (f"(country IN ('DE', 'JP') OR country IS NULL OR country IN {D.in_list(group_countries('LATAM', 'NORDICS'))} OR "
       f"{D.has_word('location', 'LATAM', 'LatAm', 'Latin America', 'Nordics', 'Nordic', 'Scandinavia')})")


@query("region_union", f"WITH {POSTINGS} SELECT posting_id, country, location FROM p WHERE {_W2}")
def region_union(t):
    """FLT-3 / SET-4: countries, unknown, groups and group names in the text add up."""
    return FL.apply_filter(postings(t), _F2, gazetteer(t.spark)).select("posting_id", "country", "location")


@query("new_only", f"WITH {POSTINGS} SELECT posting_id FROM p WHERE is_new AND posted >= TIMESTAMP '2000-06-01' - INTERVAL 400 DAY")
def new_only(t):
    """FLT-4 / DT-3."""
    f = JobFilter(new_only=True, posted_within_days=400, as_of=datetime(2000, 6, 1))
    return FL.apply_filter(postings(t), f, gazetteer(t.spark)).select("posting_id")


@query("matching_total", f"WITH {POSTINGS} SELECT count(*)::BIGINT AS total FROM p WHERE {_W1}")
def matching_total(t):
    """AGG-1."""
    return FL.apply_filter(postings(t), _F1, gazetteer(t.spark)).agg(F.count("*").alias("total"))


# ---- facets and counts ----

_FACET_TESTS = {"workplace": "(workplace = 'remote' OR workplace IS NULL)", "employment_type": "employment_type IN ('full_time', 'contract')",
                "department": "lower(department) IN ('machinery', 'building')", "source": "source IN ('lever', 'ashby', 'workday')"}


def _facet_sql(tests, names=("workplace", "employment_type", "country", "department", "source", "domain")):
    parts = []
    for n in names:
        where = " AND ".join(f"coalesce({c}, false)" for k, c in tests.items() if k != n) or "true"
        label = "max(company)" if n == "domain" else "NULL::VARCHAR"
        nulls = "" if n in ("source", "domain") else f" UNION ALL SELECT '{n}', NULL, n, l, 1e9, k FROM top_{n} WHERE v IS NULL"
        parts.append((n, f"top_{n} AS (SELECT {n} AS v, count(*) AS n, {label} AS l, row_number() OVER (ORDER BY count(*) DESC, {n} "
                         f"ASC NULLS FIRST) AS k FROM p WHERE {where} GROUP BY {n})",
                      f"SELECT '{n}' AS facet, v AS value, n AS count, l AS label, k AS o, k FROM top_{n} WHERE v IS NOT NULL{nulls}"))
    return (f"WITH {POSTINGS}, " + ", ".join(x[1] for x in parts) + ", u AS (" + " UNION ALL ".join(x[2] for x in parts) + ") "
            "SELECT facet, row_number() OVER (PARTITION BY facet ORDER BY o) AS position, value, count::BIGINT AS count, label FROM u")


@query("facet_counts", _facet_sql({}))
def facet_counts(t):
    """AGG-2: value counts of all six facets in one pass, no filter."""
    return FL.facets(postings(t), JobFilter(), gazetteer(t.spark)).withColumn("position", col("position").cast("bigint"))


@query("facet_counts_filtered", _facet_sql({**_FACET_TESTS, "country": _W2}))
def facet_counts_filtered(t):
    """AGG-2: each facet ignores its own filter only; the country facet ignores the whole region union."""
    f = JobFilter(workplace=_F1.workplace, employment_type=_F1.employment_type, department=_F1.department, source=_F1.source,
                  country=_F2.country, region_group=_F2.region_group)
    return FL.facets(postings(t), f, gazetteer(t.spark)).withColumn("position", col("position").cast("bigint"))


@query("facet_subset", _facet_sql(_FACET_TESTS, ("domain", "source")))
def facet_subset(t):
    """AGG-3: only the facets asked for."""
    return FL.facets(postings(t), _F1, gazetteer(t.spark), names=["domain", "source"]).withColumn(
        "position", col("position").cast("bigint"))


@query("company_counts", f"""
    WITH {POSTINGS} SELECT domain, count(*) FILTER (WHERE {_W2})::BIGINT AS matching, count(*)::BIGINT AS total,
    count(*) FILTER (WHERE {_W2} AND is_new)::BIGINT AS new_matching FROM p GROUP BY domain""")
def company_counts(t):
    """AGG-5: matching, all and new postings per company."""
    return FL.matching_counts(postings(t), _F2, gazetteer(t.spark))


@query("hidden_by_unknown", f"""
    WITH {POSTINGS} SELECT count(*) FILTER (WHERE employment_type = 'intern' AND (country IN {D.in_list(group_countries('DACH'))} OR {D.has_word('location', 'DACH')}) AND workplace IS NULL)::BIGINT AS workplace,
      count(*) FILTER (WHERE workplace = 'remote' AND (country IN {D.in_list(group_countries('DACH'))} OR {D.has_word('location', 'DACH')}) AND employment_type IS NULL)::BIGINT AS employment_type,
      count(*) FILTER (WHERE workplace = 'remote' AND employment_type = 'intern' AND country IS NULL)::BIGINT AS country FROM p""")
def hidden_by_unknown(t):
    """AGG-6: postings a filter leaves out only because they do not state the field."""
    f = JobFilter(workplace=["remote"], employment_type=["intern"], region_group=["DACH"])
    return FL.hidden_by_unknown(postings(t), f, gazetteer(t.spark))


@query("company_summary", f"""
    WITH {POSTINGS} SELECT domain, count(*)::BIGINT AS postings, count(*) FILTER (WHERE is_new)::BIGINT AS new_postings,
    count(DISTINCT department)::BIGINT AS departments, count(DISTINCT location)::BIGINT AS locations, arg_max(source, posting_id) AS source
    FROM p GROUP BY domain""")
def company_summary(t):
    """AGG-17: one line per company."""
    return postings(t).groupBy("domain").agg(
        F.count("*").alias("postings"), F.count_if("is_new").alias("new_postings"), F.count_distinct("department").alias("departments"),
        F.count_distinct("location").alias("locations"), F.max_by("source", "posting_id").alias("source"))


@query("progress", """
    SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) / count(*))::BIGINT AS percent
    FROM orders GROUP BY o_orderpriority""")
def progress(t):
    """AGG-8: finished among those in play, in percent."""
    done = F.count_if(col("o_orderstatus").isin("F", "O"))
    return t.orders.groupBy("o_orderpriority").agg(F.round(100 * done / F.count("*")).cast("bigint").alias("percent"))


@query("companies_without_postings", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def companies_without_postings(t):
    """AGG-16 / SET-3: finished companies with nothing to show."""
    return t.customer.join(t.orders.select(col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("common_company_name", """
    SELECT n_nationkey, name FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS name, row_number() OVER (PARTITION BY c_nationkey
      ORDER BY count(*) DESC, min(c_custkey)) AS k FROM customer GROUP BY 1, 2) WHERE k = 1""")
def common_company_name(t):
    """AGG-11: the most common spelling, the first seen among equals."""
    from ..operators.cascade import most_common
    return most_common(t.customer, ["c_nationkey"], "c_mktsegment", "c_custkey").select(
        col("c_nationkey").alias("n_nationkey"), col("c_mktsegment").alias("name"))


# ---- sorting and paging ----

@query("sorted_page", f"""
    WITH {POSTINGS} SELECT posting_id, title FROM p ORDER BY lower(title) ASC, posting_id DESC LIMIT 200 OFFSET 300""")
def sorted_page(t):
    """SRT-1 / SRT-3: one page of a total order."""
    return FL.page(postings(t), 200, "title", "asc", offset=300).select("posting_id", "title")


@query("newest_page", f"""
    WITH {POSTINGS} SELECT posting_id, CASE WHEN is_new THEN posted END AS posted FROM p ORDER BY posted DESC NULLS LAST, posting_id DESC LIMIT 100""")
def newest_page(t):
    """SRT-1: newest first, unknown dates last."""
    p = postings(t).withColumn("posted", F.when(col("is_new"), col("posted")))
    return FL.page(p, 100).select("posting_id", "posted")


# ---- search ----

def _tokens_sql(x):
    return f"(' ' || trim(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


_DOC = f"d AS (SELECT doc_id, {_tokens_sql('text')} AS t, {_tokens_sql('source')} AS s, {_tokens_sql('lang')} AS l FROM documents)"


def _docs(t):
    return t.documents.select("doc_id", col("text").alias("title"), col("source").alias("company"), col("lang").alias("country"))


def _any_field(text):
    return f"(contains(t, '{text}') OR contains(s, '{text}') OR contains(l, '{text}'))"


_SEARCH = dict(all_of=[["le", "of the"], ["tion", '"en la"', "src7"]], none_of=["que les", "zz"])
_SEARCH_SQL = (f"({_any_field(' le')} OR {_any_field(' of the ')}) AND ({_any_field(' tion')} OR {_any_field(' en la ')} OR "
               f"{_any_field(' src7')}) AND NOT {_any_field(' que les ')} AND NOT {_any_field(' zz')}")


@query("text_search", f"WITH {_DOC} SELECT doc_id FROM d WHERE {_SEARCH_SQL}")
def text_search(t):
    """FTS-1 / FTS-3 / FTS-5: prefixes, phrases inside one field, alternatives and exclusions, as one filter."""
    return S.search(_docs(t), Search.of(**_SEARCH), ["title", "company", "country"]).select("doc_id")


@query("text_search_index", f"WITH {_DOC} SELECT doc_id FROM d WHERE {_SEARCH_SQL}")
def text_search_index(t):
    """FTS-2 / FTS-3 / FTS-5: the same answers from the token table."""
    index = S.search_tokens(_docs(t), "doc_id", ["title", "company", "country"])
    return S.matching_ids(index, Search.of(**_SEARCH), "doc_id")


@query("text_search_excluding", f"WITH {_DOC} SELECT doc_id FROM d WHERE NOT {_any_field(' the')} AND NOT {_any_field(' de la ')}")
def text_search_excluding(t):
    """FTS-5: exclusions alone are a valid search."""
    index = S.search_tokens(_docs(t), "doc_id", ["title", "company", "country"])
    return S.matching_ids(index, Search.of(none_of=["the", "de la"]), "doc_id", everything=t.documents)


@query("text_search_place", f"WITH {_DOC} SELECT doc_id, lang FROM d JOIN documents USING (doc_id) WHERE {_any_field(' germany')} OR contains(l, ' de ')")
def text_search_place(t):
    """FTS-4 / FTS-6: a place name also finds rows whose country field has its code."""
    return S.search(_docs(t), Search.of(all_of=["germany"]), ["title", "company", "country"], gazetteer(t.spark)).select(
        "doc_id", col("country").alias("lang"))


@query("search_token_counts", """
    SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS documents FROM (SELECT doc_id, unnest(string_split(trim(
      regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY term""")
def search_token_counts(t):
    """FTS-2: the tokens of every text."""
    index = S.search_tokens(t.documents.select("doc_id", col("text").alias("title")), "doc_id", ["title"])
    per_doc = index.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


@query("search_index_refresh", """
    SELECT p_partkey, count(*)::BIGINT AS tokens, string_agg(term, ' ' ORDER BY pos) AS terms FROM (SELECT p_partkey, unnest(w) AS term, unnest(range(len(w))) AS pos
      FROM (SELECT p_partkey, string_split(lower(p_name) || CASE WHEN p_size > 25 THEN ' new' ELSE '' END, ' ') AS w FROM part)) GROUP BY p_partkey""")
def search_index_refresh(t):
    """MNT-5: the index after an update, only changed rows tokenised again."""
    old = S.search_tokens(t.part.select("p_partkey", col("p_name").alias("title")), "p_partkey", ["title"])
    changed = t.part.filter(col("p_size") > 25).select("p_partkey", F.concat("p_name", lit(" NEW")).alias("title"))
    index = S.refresh_tokens(old, changed, "p_partkey", ["title"])
    terms = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    return index.groupBy("p_partkey").agg(F.count("*").alias("tokens"), F.array_join(terms, " ").alias("terms"))


@query("substring_search", """
    SELECT p_partkey, p_name FROM part WHERE (contains(h, 'ed w') OR contains(h, 'd#1')) AND NOT contains(h, '%') AND NOT contains(h, 'gear')
    """.replace("FROM part", "FROM (SELECT *, lower(p_name || ' ' || p_brand) AS h FROM part)"))
def substring_search(t):
    """FTS-7: substring semantics over the joined fields."""
    q = Search.of(all_of=[['"ed w"', '"d#1"']], none_of=["gear", '"% x"'])
    return t.part.filter(S.substring_condition(q, ["p_name", "p_brand"], country=None)).select("p_partkey", "p_name")


# ---- geography ----

@query("group_members", f"""
    SELECT n_nationkey, country, g AS region_group FROM (SELECT n_nationkey, {D.pick(NATION_CODES, 'n_nationkey')} AS country FROM nation)
    JOIN (VALUES {', '.join(f"('{k}', '{c}')" for k, e in REGION_GROUPS.items() if e.get('label') for c in group_countries(k))}) v(g, c) ON c = country""")
def group_members(t):
    """GEO-10 / GEO-11: the groups each nation belongs to, included groups closed over."""
    n = t.nation.select("n_nationkey", pick(NATION_CODES, col("n_nationkey")).alias("country"))
    return n.join(F.broadcast(gazetteer(t.spark).group_members()), "country").select("n_nationkey", "country", "region_group")


@query("alias_in_text", f"WITH {POSTINGS} SELECT region_group, count(*)::BIGINT AS postings FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS region_group FROM p WHERE {D.has_word('location', *e.get('aliases', [k]))}"
    for k, e in REGION_GROUPS.items() if e.get("label")) + ") GROUP BY 1")
def alias_in_text(t):
    """JOIN-8: texts naming a region group. The aliases are a fixed list, so each row tests them in place: no join at all."""
    names = {k: gazetteer(t.spark).group_aliases(k) for k, e in REGION_GROUPS.items() if e.get("label")}
    hits = F.array_compact(F.array(*[F.when(TX.has_any_word(col("location"), a), lit(k)) for k, a in names.items()]))
    return (postings(t).select("posting_id", F.explode(hits).alias("region_group"))
            .groupBy("region_group").agg(F.count("*").alias("postings")))


COUNTRY_TEXT = ["Germany", "us", "U.S.A.", "Georgia", "españa", "Atlantis", " uk ", "Korea", "GE", "the netherlands", "", "Türkiye", "Holland", "zz"]
COUNTRY_WANT = ["DE", "US", "US", None, "ES", None, "GB", "KR", "GE", "NL", None, "TR", "NL", None]


@query("country_of", f"SELECT c_custkey, {D.pick(COUNTRY_WANT, 'c_custkey')} AS country FROM customer")
def country_of(t):
    """GEO-1: feed country text -> ISO code."""
    c = t.customer.select("c_custkey", pick(COUNTRY_TEXT, col("c_custkey")).alias("raw"))
    return G.normalize_countries(c, gazetteer(t.spark), "raw", "country").select("c_custkey", "country")


REGION_TEXT = [("US", "ca"), ("CA", "ON"), ("US", "Ontario"), (None, "texas"), ("GB", " Kent  "), ("CA", "québec"), ("US", ""), ("DE", "BE"), (None, "NY"), ("US", "DC")]
REGION_WANT = ["California", "Ontario", "Ontario", "Texas", "Kent", "Quebec", None, "BE", "NY", "District of Columbia"]


@query("region_of", f"SELECT c_custkey, {D.pick(REGION_WANT, 'c_custkey')} AS region FROM customer")
def region_of(t):
    """GEO-2 / GEO-3: feed region text -> full name where the country has it, else as given."""
    c = t.customer.select("c_custkey", pick([x[0] for x in REGION_TEXT], col("c_custkey")).alias("iso"),
                          pick([x[1] for x in REGION_TEXT], col("c_custkey")).alias("raw"))
    return G.normalize_regions(c, gazetteer(t.spark), "raw", "iso", "region").select("c_custkey", "region")


@query("country_names", f"SELECT n_nationkey, code, {D.pick([{'DE': 'Germany', 'US': 'United States', 'FR': 'France', 'GB': 'United Kingdom', 'IN': 'India', 'BR': 'Brazil', 'JP': 'Japan', 'CA': 'Canada', 'ES': 'Spain', 'PL': 'Poland', 'IE': 'Ireland', 'AU': 'Australia', 'NZ': 'New Zealand', 'CH': 'Switzerland', 'AT': 'Austria', 'NO': 'Norway', 'SE': 'Sweden', 'MX': 'Mexico', 'ZA': 'South Africa', 'AE': 'United Arab Emirates', 'SG': 'Singapore', 'CN': 'China', 'KR': 'South Korea', 'IT': 'Italy'}.get(c) for c in NATION_CODES], 'n_nationkey')} AS name FROM (SELECT n_nationkey, {D.pick(NATION_CODES, 'n_nationkey')} AS code FROM nation)")
def country_names(t):
    """GEO-4: display names, in order of the folded name."""
    n = t.nation.select("n_nationkey", pick(NATION_CODES, col("n_nationkey")).alias("code"))
    return (n.join(F.broadcast(gazetteer(t.spark).country_list), "code", "left").orderBy("name_key").select("n_nationkey", "code", "name"))


PLACE_TEXT = [
    ("Denver, CO", "Denver", "Colorado", "US"), ("Spain, Remote", None, None, "ES"), ("Mars Base", None, None, None),
    ("Chicago, Illinois, US", "Chicago", "Illinois", "US"), ("Somerville, IN", None, None, None), ("Porto, Portugal", "Porto", None, "PT"),
    ("Several sites / Lisbon, Portugal", "Lisbon", None, "PT"), ("Japan, Osaka (+5 more)", "Osaka", None, "JP"),
    ("Hybrid | Madrid, Spain", "Madrid", None, "ES"), ("Savannah, Georgia", None, None, None), ("Atlanta, Georgia, USA", "Atlanta", "Georgia", "US"),
    ("Ohio", None, "Ohio", "US"), ("Montréal, Quebec", "Montreal", "Quebec", "CA"), ("Norway", None, None, "NO"),
    # cities alone, one name in several places, other spellings
    ("Orlando", "Orlando", "Florida", "US"), ("nashville", "Nashville", "Tennessee", "US"), ("Sacramento", "Sacramento", "California", "US"),
    ("RALEIGH", "Raleigh", "North Carolina", "US"), ("Remote - Milwaukee", "Milwaukee", "Wisconsin", "US"), ("Honolulu", "Honolulu", "Hawaii", "US"),
    ("Hybrid | Ann Arbor", "Ann Arbor", "Michigan", "US"), ("Edmonton", "Edmonton", "Alberta", "CA"), ("Québec City", "Quebec City", "Quebec", "CA"),
    ("Glasgow", "Glasgow", None, "GB"), ("Leeds", "Leeds", None, "GB"), ("Belfast", "Belfast", None, "GB"), ("Galway", "Galway", None, "IE"),
    ("Stuttgart", "Stuttgart", None, "DE"), ("Düsseldorf", "Düsseldorf", None, "DE"), ("Den Haag", "The Hague", None, "NL"), ("Marseille", "Marseille", None, "FR"),
    ("Torino", "Turin", None, "IT"), ("Göteborg", "Gothenburg", None, "SE"), ("Wrocław", "Wroclaw", None, "PL"), ("București", "Bucharest", None, "RO"),
    ("Kiev", "Kyiv", None, "UA"), ("Tallinn", "Tallinn", None, "EE"), ("Nairobi", "Nairobi", None, "KE"), ("Riyadh", "Riyadh", None, "SA"),
    ("Calcutta", "Kolkata", None, "IN"), ("Gurugram", "Gurgaon", None, "IN"), ("Saigon", "Ho Chi Minh City", None, "VN"), ("Medellin", "Medellín", None, "CO"),
    ("Rio de Janeiro", "Rio de Janeiro", None, "BR"), ("Osaka", "Osaka", None, "JP"), ("Richmond", None, None, None), ("Birmingham", None, None, None),
    ("Valencia", None, None, None), ("Wellington", None, None, None), ("Columbus, OH", "Columbus", "Ohio", "US"), ("Birmingham, UK", "Birmingham", None, "GB"),
    ("Madison, WI", "Madison", "Wisconsin", "US"), ("Reading, England", "Reading", None, "GB"), ("Remote", None, None, None), ("", None, None, None)]


@query("places_read", f"""
    SELECT o_orderkey, {D.pick([x[1] for x in PLACE_TEXT], 'o_orderkey')} AS city, {D.pick([x[2] for x in PLACE_TEXT], 'o_orderkey')} AS region,
    {D.pick([x[3] for x in PLACE_TEXT], 'o_orderkey')} AS country FROM orders""")
def places_read(t):
    """GEO-5 / GEO-6 / GEO-7 / GEO-8: location text -> place; distinct texts are read once and joined back."""
    o = t.orders.select("o_orderkey", pick([x[0] for x in PLACE_TEXT], col("o_orderkey")).alias("location"))
    places = G.read_places(o, "location", gazetteer(t.spark))
    return o.join(places, o.location == places.text, "left").select("o_orderkey", "city", "region", "country")


FEED = [(None, None, None), ("Lyon", "Rhône", "fr"), (None, None, "GB"), (None, "CA", "United States"), (None, None, "Atlantis")]


@query("places_merged", f"""
    WITH o AS (SELECT o_orderkey, {D.pick([x[1] for x in PLACE_TEXT], 'o_orderkey')} AS pc, {D.pick([x[2] for x in PLACE_TEXT], 'o_orderkey')} AS pr,
      {D.pick([x[3] for x in PLACE_TEXT], 'o_orderkey')} AS pi, {D.pick([None, 'Lyon', None, None, None], 'o_orderkey')} AS fc,
      {D.pick([None, 'Rhône', None, 'California', None], 'o_orderkey')} AS fr, {D.pick([None, 'FR', 'GB', 'US', None], 'o_orderkey')} AS fi FROM orders),
    k AS (SELECT *, coalesce(fc, fr, fi) IS NOT NULL AS feed, pi IS NULL OR fi IS NULL OR pi = fi AS agrees FROM o)
    SELECT o_orderkey, CASE WHEN feed AND NOT agrees THEN fc WHEN feed THEN coalesce(fc, pc) ELSE pc END AS city,
      CASE WHEN feed AND NOT agrees THEN fr WHEN feed THEN coalesce(fr, pr) ELSE pr END AS region,
      CASE WHEN feed AND NOT agrees THEN fi WHEN feed THEN coalesce(fi, pi) ELSE pi END AS country,
      CASE WHEN feed THEN 'feed' WHEN coalesce(pc, pr, pi) IS NOT NULL THEN 'parsed' END AS geo_confidence FROM k""")
def places_merged(t):
    """GEO-9: feed structure first, text fills gaps unless it contradicts."""
    k = col("o_orderkey")
    o = t.orders.select("o_orderkey", pick([x[0] for x in PLACE_TEXT], k).alias("location"), pick([x[0] for x in FEED], k).alias("city"),
                        pick([x[1] for x in FEED], k).alias("region"), pick([x[2] for x in FEED], k).alias("country"))
    return G.add_places(o, gazetteer(t.spark)).select("o_orderkey", "city", "region", "country", "geo_confidence")


@query("places_backfill", f"""
    WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS has, {D.pick([x[1] for x in PLACE_TEXT], 'o_orderkey')} AS pc,
      {D.pick([x[2] for x in PLACE_TEXT], 'o_orderkey')} AS pr, {D.pick([x[3] for x in PLACE_TEXT], 'o_orderkey')} AS pi FROM orders)
    SELECT o_orderkey, CASE WHEN has THEN 'Kept' ELSE pc END AS city, CASE WHEN NOT has THEN pr END AS region, CASE WHEN NOT has THEN pi END AS country,
      CASE WHEN has THEN 'feed' WHEN coalesce(pc, pr, pi) IS NOT NULL THEN 'parsed' END AS geo_confidence FROM o""")
def places_backfill(t):
    """GEO-13: place columns for stored rows that lack them."""
    has, none = col("o_orderstatus") == "F", lit(None).cast("string")
    o = t.orders.select("o_orderkey", pick([x[0] for x in PLACE_TEXT], col("o_orderkey")).alias("location"),
                        F.when(has, "Kept").alias("city"), none.alias("region"), none.alias("country"),
                        F.when(has, "feed").alias("geo_confidence"))
    return G.backfill_places(o, gazetteer(t.spark)).select("o_orderkey", "city", "region", "country", "geo_confidence")


SEARCH_WORDS = ["nyc", "germany", "bay area", "engineer", "nordics", "georgia", "bangalore"]


@query("term_expansion", f"""
    SELECT c_custkey, term, CASE term WHEN 'nyc' THEN 5 WHEN 'germany' THEN 2 WHEN 'bay area' THEN {len(METROS['Bay Area']) + 1} WHEN 'nordics' THEN 8
      WHEN 'bangalore' THEN 2 ELSE 1 END::BIGINT AS alternatives FROM (SELECT c_custkey, {D.pick(SEARCH_WORDS, 'c_custkey')} AS term FROM customer)""")
def term_expansion(t):
    """GEO-12: how many phrases each search word stands for."""
    g = gazetteer(t.spark)
    counts = F.create_map(*[x for w in SEARCH_WORDS for x in (lit(w), lit(len(g.expand(w))))])
    c = t.customer.select("c_custkey", pick(SEARCH_WORDS, col("c_custkey")).alias("term"))
    return c.select("c_custkey", "term", counts[col("term")].cast("bigint").alias("alternatives"))
