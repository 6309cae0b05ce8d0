"""Readers: board feed answers -> feed rows for `conform`. One function per platform, all DataFrame -> DataFrame.

Input is API_RESPONSES (one row per answer). Output columns: domain, ats, token, pos columns, and the feed fields.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as DT, text as TX, variants as J, vocab as V
from ..operators.geo import is_subdivision_code, subdivision_name
from ..operators.keyed import computed, kept, with_known_size
from ..session import shared_folder
from . import apis
from .gazetteer import Gazetteer

FEED_FIELDS = ["company", "title", "url", "location", "remote", "department", "posted", "source", "workplace",
               "employment_type", "city", "region", "country"]
_TEXT = {f: "string" for f in FEED_FIELDS} | {"remote": "boolean", "posted": "timestamp"}

# Names of the custom fields holding workplace and employment type.
WORKPLACE_FIELD = r"(?i)workplace|remote|location type"
EMPLOYMENT_FIELD = r"(?i)employment type|job type|contract type|worker type|commitment"

GREENHOUSE = ("jobs ARRAY<STRUCT<id: BIGINT, title: STRING, company_name: STRING, absolute_url: STRING, "
              "location: STRUCT<name: STRING>, first_published: STRING, updated_at: STRING, "
              "metadata: ARRAY<STRUCT<name: STRING, value: VARIANT>>>>")
DEPARTMENTS = "departments ARRAY<STRUCT<name: STRING, jobs: ARRAY<STRUCT<id: BIGINT>>>>"
LEVER = ("ARRAY<STRUCT<text: STRING, hostedUrl: STRING, categories: STRUCT<location: STRING, allLocations: ARRAY<STRING>, "
         "team: STRING, department: STRING, commitment: STRING>, workplaceType: STRING, createdAt: BIGINT, country: STRING>>")
ASHBY = ("jobs ARRAY<STRUCT<title: STRING, jobUrl: STRING, isListed: BOOLEAN, location: STRING, "
         "secondaryLocations: ARRAY<STRUCT<location: STRING>>, department: STRING, team: STRING, workplaceType: STRING, "
         "publishedAt: STRING, employmentType: STRING, address: STRUCT<postalAddress: STRUCT<addressLocality: STRING, "
         "addressRegion: STRING, addressCountry: STRING>>>>")
WORKDAY = ("total BIGINT, jobPostings ARRAY<STRUCT<title: STRING, externalPath: STRING, locationsText: STRING, "
           "postedOn: STRING, remoteType: STRING>>")
SMARTRECRUITERS = ("totalFound BIGINT, content ARRAY<STRUCT<id: STRING, name: STRING, company: STRUCT<name: STRING>, "
                   "location: VARIANT, department: STRUCT<label: STRING>, releasedDate: STRING, createdOn: STRING, "
                   "typeOfEmployment: STRUCT<id: STRING, label: STRING>>>")
ORACLE = ("items ARRAY<STRUCT<TotalJobsCount: BIGINT, requisitionList: ARRAY<STRUCT<Id: STRING, Title: STRING, "
          "PostedDate: STRING, PrimaryLocation: STRING, PrimaryLocationCountry: STRING, WorkplaceType: STRING, "
          "JobSchedule: STRING, WorkerType: STRING, ContractType: STRING, JobType: STRING, JobFamily: STRING, "
          "JobFunction: STRING, Department: STRING, Organization: STRING, secondaryLocations: ARRAY<STRUCT<Name: STRING, "
          "CountryCode: STRING>>, workLocation: ARRAY<STRUCT<TownOrCity: STRING, Region2: STRING, Country: STRING>>>>>>")


def _or(*values: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _feed(df: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    return df.select(*keep, *[fields.get(f, F.lit(None)).cast(_TEXT[f]).alias(f) for f in FEED_FIELDS])


def _when(responses: DataFrame) -> list[str]:
    return [c for c in ("fetched_at",) if c in responses.columns]


def _answers(responses: DataFrame, ats: str, endpoint: str | None = None) -> DataFrame:
    rows = responses.filter((F.col("ats") == ats) & (F.col("status") == 200))
    return rows if endpoint is None else rows.filter(F.col("endpoint") == endpoint)


def greenhouse(responses: DataFrame) -> DataFrame:
    """Endpoints 'jobs' and 'departments'. A job's department is the first that lists it; workplace and employment type
    are custom fields found by name."""
    jobs = (_answers(responses, "greenhouse", "jobs").select(*apis.BOARD, F.from_json("body", GREENHOUSE).alias("d"))
            .select(*apis.BOARD, F.posexplode("d.jobs").alias("pos", "j")))
    named = (_answers(responses, "greenhouse", "departments").select(*apis.BOARD, F.from_json("body", DEPARTMENTS).alias("d"))
             .select(*apis.BOARD, F.posexplode("d.departments").alias("at", "p"))
             .filter((F.coalesce("p.name", F.lit("")) != "") & (F.lower("p.name") != "no department"))
             .select(*apis.BOARD, "at", "p.name", F.explode("p.jobs.id").alias("job_id")))
    first = named.groupBy(*apis.BOARD, "job_id").agg(F.min_by("name", "at").alias("department"))
    joined = jobs.withColumn("job_id", F.col("j.id")).join(first, [*apis.BOARD, "job_id"], "left")

    def custom(pattern: str) -> Column:
        hits = F.filter("j.metadata", lambda m: F.coalesce(m["name"], F.lit("None")).rlike(pattern) & J.is_string(m["value"]))
        return J.scalar(F.get(hits, F.lit(0))["value"])

    return _feed(joined, [*apis.BOARD, "pos"], company=_or(F.col("j.company_name")), title=F.col("j.title"), url=F.col("j.absolute_url"),
                 location=TX.clean(F.col("j.location.name")), workplace=custom(WORKPLACE_FIELD),
                 employment_type=custom(EMPLOYMENT_FIELD), department=F.col("department"),
                 posted=DT.from_text(_or(F.col("j.first_published"), F.col("j.updated_at"))), source=F.lit("greenhouse"))


def lever(responses: DataFrame) -> DataFrame:
    rows = (_answers(responses, "lever").select(*apis.BOARD, F.posexplode(F.from_json("body", LEVER)).alias("pos", "j")))
    many = F.col("j.categories.allLocations")
    location = F.when(F.size(many) > 0, TX.clean_list(many)).otherwise(TX.clean(F.col("j.categories.location")))
    return _feed(rows, [*apis.BOARD, "pos"], title=F.col("j.text"), url=F.col("j.hostedUrl"), location=location,
                 workplace=F.col("j.workplaceType"), employment_type=F.col("j.categories.commitment"), country=F.col("j.country"),
                 department=_or(F.col("j.categories.department"), F.col("j.categories.team")),
                 posted=DT.from_epoch(F.col("j.createdAt")), source=F.lit("lever"))


def ashby(responses: DataFrame) -> DataFrame:
    """Unlisted rows are left out; isRemote is ignored in favour of workplaceType."""
    rows = (_answers(responses, "ashby").select(*apis.BOARD, F.posexplode(F.from_json("body", ASHBY)["jobs"]).alias("pos", "j"))
            .filter(F.coalesce("j.isListed", F.lit(True))))
    address = F.col("j.address.postalAddress")
    places = F.concat(F.array("j.location"), F.coalesce("j.secondaryLocations.location", F.array().cast("array<string>")))
    return _feed(rows, [*apis.BOARD, "pos"], title=F.col("j.title"), url=F.col("j.jobUrl"), location=TX.clean_list(places),
                 workplace=F.col("j.workplaceType"), employment_type=F.col("j.employmentType"), city=address["addressLocality"],
                 region=address["addressRegion"], country=address["addressCountry"],
                 department=_or(F.col("j.department"), F.col("j.team")), posted=DT.from_text(F.col("j.publishedAt")), source=F.lit("ashby"))


# ---- Workday: the path of a posting holds its place ----

def slug_place(df: DataFrame, slug: str, gazetteer: Gazetteer) -> DataFrame:
    """Place hidden in a path step: US-CA-Santa-Clara, GB-London, Israel-Tel-Aviv; adds slug_city, slug_region,
    slug_country. A prefix that could be a US or Canadian code, or begin a city's name, is not read."""
    s, words = F.col(slug), F.split(slug, "-")

    def city_from(rest: Column) -> Column:
        return F.when((rest != "") & ~rest.rlike(V.SLUG_WORKPLACE), F.replace(rest, F.lit("-"), F.lit(" ")))

    def upto(n: int) -> Column:
        return F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " "))

    work = computed(df, __n3=TX.fold(upto(3)), __n2=TX.fold(upto(2)), __n1=TX.fold(upto(1)))
    for n in (3, 2, 1):
        names = F.broadcast(gazetteer.country_names.select(F.col("name_key").alias(f"__k{n}"), F.col("iso").alias(f"__iso{n}")))
        work = work.join(names, F.col(f"__n{n}") == F.col(f"__k{n}"), "left")
    codes = list(gazetteer.countries)
    one = upto(1)

    def trusted(n: int) -> Column:
        name = upto(n)
        fits = ~F.lower(name).isin(V.SLUG_NAME_DENY) & ~name.rlike(r"^\p{Lu}{2}$") & ~F.col(f"__n{n}").isin(V.NEEDS_CITY)
        iso = F.col(f"__iso{n}")
        if n == 1:
            iso = F.when((F.length(one) == 2) & F.upper(one).isin(codes), F.upper(one)).otherwise(iso)
        return F.when(fits, iso)

    state = r"^([A-Z]{2})-([A-Z]{2})-(.+)$"
    c1, c2, c3 = (F.regexp_extract(s, state, g) for g in (1, 2, 3))
    by_state = c1.isin("US", "CA") & subdivision_name(c1, c2).isNotNull()
    p1, p2 = (F.regexp_extract(s, r"^([A-Z]{2})-(.+)$", g) for g in (1, 2))
    by_code = p1.isin(codes) & ~is_subdivision_code(p1)
    size = F.when(trusted(3).isNotNull(), 3).when(trusted(2).isNotNull(), 2).when(trusted(1).isNotNull(), 1)
    named = F.coalesce(trusted(3), trusted(2), trusted(1))
    work = computed(work, __size=size, __named=named)
    rest = F.slice(words, F.col("__size") + 1, F.size(words))
    has_state = F.col("__named").isin("US", "CA") & (F.size(rest) > 1) & subdivision_name(
        F.col("__named"), F.get(rest, F.lit(0))).isNotNull()
    after = F.when(F.coalesce(has_state, F.lit(False)), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))).otherwise(rest)
    return computed(
        work,
        slug_country=F.when(by_state, c1).when(by_code, p1).otherwise(F.col("__named")),
        slug_region=F.when(by_state, c2).when(by_code, F.lit(None).cast("string")).when(has_state, F.get(rest, F.lit(0))),
        slug_city=F.when(by_state, city_from(c3)).when(by_code, city_from(p2))
        .when(F.col("__named").isNotNull(), city_from(F.array_join(after, "-")))).drop(
            *[f"__{x}{n}" for x in ("n", "k", "iso") for n in (1, 2, 3)], "__size", "__named")


def workday_location(text: Column, path: Column) -> Column:
    """'4 Locations' -> the first place from the path and '(+3 more)'; any other text is kept."""
    many = F.regexp_extract(text, r"(?i)^(\d+)\s+Locations$", 1)
    steps = F.split(path, "/")
    primary = F.when((F.size(steps) > 2) & (F.get(steps, F.lit(1)) == "job"), F.replace(F.get(steps, F.lit(2)), F.lit("-"), F.lit(" ")))
    return F.when((many != "") & (F.coalesce(primary, F.lit("")) != ""), F.concat(
        primary, F.lit(" (+"), (many.try_cast("bigint") - 1).cast("string"), F.lit(" more)"))).otherwise(text)


def workday(responses: DataFrame, gazetteer: Gazetteer, as_of: Column, max_jobs: int | None = None) -> DataFrame:
    """Paged by 20; token is tenant/site, `endpoint` the board's host."""
    pages = _answers(responses, "workday").withColumn("d", F.from_json("body", WORKDAY)).select(
        *apis.BOARD, "endpoint", *_when(responses), "page_offset", F.coalesce("d.total", F.lit(0)).alias("total"), F.col("d.jobPostings").alias("items"))
    hosts = pages.groupBy(*apis.BOARD).agg(F.min("endpoint").alias("host"))
    rows = apis.board_rows(pages, max_jobs).join(hosts, apis.BOARD)
    steps = F.split("item.externalPath", "/")
    rows = rows.withColumn("slug", F.when((F.size(steps) > 2) & (F.get(steps, F.lit(1)) == "job"), F.get(steps, F.lit(2))))
    # answers are parsed once; a place is read once per distinct path step
    rows = kept(rows, f"{shared_folder(responses.sparkSession)}/workday-{uuid.uuid4().hex}", "rows")
    places = slug_place(rows.select("slug").filter(F.col("slug").isNotNull()).distinct(), "slug", gazetteer)
    rows = rows.join(with_known_size(places), "slug", "left")
    return _feed(rows, [*apis.BOARD, "page_offset", "pos"], title=F.col("item.title"),
                 url=F.concat(F.lit("https://"), "host", F.lit("/"), F.substring_index("token", "/", -1),
                              F.coalesce("item.externalPath", F.lit(""))),
                 location=TX.clean(workday_location(F.coalesce("item.locationsText", F.lit("")), F.coalesce("item.externalPath", F.lit("")))),
                 workplace=F.col("item.remoteType"), city=F.col("slug_city"), region=F.col("slug_region"), country=F.col("slug_country"),
                 posted=DT.from_text(F.col("item.postedOn"), as_of), source=F.lit("workday"))


def smartrecruiters(responses: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Paged by 100. A company without postings is not on this platform and gives no rows."""
    pages = _answers(responses, "smartrecruiters").withColumn("d", F.from_json("body", SMARTRECRUITERS)).select(
        *apis.BOARD, *_when(responses), "page_offset", F.coalesce("d.totalFound", F.lit(0)).alias("total"), F.col("d.content").alias("items"))
    rows = apis.board_rows(pages, max_jobs)
    place = F.col("item.location")

    def part(key: str) -> Column:
        return J.scalar(J.get(place, key))

    return _feed(rows, [*apis.BOARD, "page_offset", "pos"], company=_or(F.col("item.company.name")), title=F.col("item.name"),
                 url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), "item.id"),
                 location=F.coalesce(TX.clean(part("fullLocation")), TX.clean_list(F.array(part("city"), part("country")))),
                 workplace=apis.workplace_flags(place), employment_type=_or(F.col("item.typeOfEmployment.label"), F.col("item.typeOfEmployment.id")),
                 city=part("city"), region=part("region"), country=part("country"), department=F.col("item.department.label"),
                 posted=DT.from_text(_or(F.col("item.releasedDate"), F.col("item.createdOn"))), source=F.lit("smartrecruiters"))


def oracle(responses: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Paged by 50; token is host/site, `endpoint` the language. Rows without an Id are left out."""
    first = F.get("d.items", F.lit(0))
    pages = _answers(responses, "oracle").withColumn("d", F.from_json("body", ORACLE)).select(
        *apis.BOARD, "endpoint", *_when(responses), "page_offset", first["TotalJobsCount"].alias("total"), first["requisitionList"].alias("items"))
    languages = pages.groupBy(*apis.BOARD).agg(F.min("endpoint").alias("lang"))
    rows = apis.board_rows(pages, max_jobs).join(languages, apis.BOARD).filter(F.coalesce("item.Id", F.lit("")) != "")
    j = F.col("item")
    work = F.get(F.filter(j["workLocation"], lambda w: _or(w["TownOrCity"], w["Country"]).isNotNull()), F.lit(0))
    extra = F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["Name"]), F.array().cast("array<string>"))
    return _feed(rows, [*apis.BOARD, "page_offset", "pos"], title=j["Title"],
                 url=F.concat(F.lit("https://"), F.substring_index("token", "/", 1), F.lit("/hcmUI/CandidateExperience/"),
                              F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")), F.lit("/sites/"), F.substring_index("token", "/", -1),
                              F.lit("/job/"), j["Id"]),
                 location=TX.clean_list(F.concat(F.array(j["PrimaryLocation"]), extra)), workplace=_or(j["WorkplaceType"]),
                 employment_type=_or(j["JobSchedule"], j["WorkerType"], j["ContractType"], j["JobType"]),
                 department=_or(j["JobFamily"], j["JobFunction"], j["Department"], j["Organization"]),
                 city=work["TownOrCity"], region=work["Region2"], country=_or(work["Country"], j["PrimaryLocationCountry"]),
                 posted=DT.from_text(j["PostedDate"]), source=F.lit("oracle"))


# ---- a company's own reader ----

Reader = Callable[[DataFrame], DataFrame]


def with_adapters(payloads: DataFrame, adapters: dict[str, Reader], generic: Reader, domain: str = "domain") -> DataFrame:
    """Rows from each company's own reader where one is registered and finds something, else from the generic one.

    The set of adapters is the caller's code, so it is small; every reader sees only its company's payloads.
    """
    if not adapters:
        return generic(payloads)
    own = [reader(payloads.filter(F.col(domain) == name)) for name, reader in adapters.items()]
    found = own[0]
    for rows in own[1:]:
        found = found.unionByName(rows, allowMissingColumns=True)
    served = found.select(domain).distinct()
    return found.unionByName(generic(payloads.join(served, domain, "left_anti")), allowMissingColumns=True)
