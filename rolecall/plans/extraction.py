"""Queries over embedded data, page JSON, hiring platforms and board feeds.

The crawled pages hold none of these, so they are written from the order tables: one page, payload or feed answer per
order, in several shapes. The SQL side computes what must come out from the orders themselves.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import classify as C, text as TX, urls as U, variants as J, vocab as V
from ..operators import boards as B, cascade as CA, conform as CF, jsonld as LD, reading as RG, sniff as SN
from ..operators.keyed import kept, spread
from ..session import shared_folder
from ..sources import apis, readers as RD
from . import duck as D
from .postings import gazetteer
from .registry import pick, query, utc

col, lit = F.col, F.lit


def _text(c):
    return c.cast("string")


# ---- JSON-LD ----

def ld_pages(t):
    """One page per order holding JSON-LD in one of five shapes."""
    k, title, day = _text(col("o_orderkey")), col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")
    own = F.concat(lit('{"@context":"https://schema.org","@type":"JobPosting","title":"'), title, lit('  Engineer","url":"/jobs/'), k,
                   lit('","datePosted":"'), day, lit('","employmentType":["FULL_TIME","PART_TIME"],"jobLocationType":"telecommute",'
                       '"hiringOrganization":{"name":"Acme \tInc"},"jobLocation":{"address":{"addressLocality":"Berlin",'
                       '"addressRegion":"BE","addressCountry":{"name":"Germany"}}}}'))
    graph = F.concat(lit('{"@graph":[{"@type":"WebSite"},{"@type":["Thing","JobPosting"],"title":"'), title,
                     lit('"},[{"item":{"@type":"JobPosting","name":"'), title, lit('","industry":["A","B","A"]}}],{"@type":"JobPosting","title":"'),
                     title, lit(' 2"}]}'))
    items = F.concat(lit('{"@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"item":{"@type":"JobPosting","identifier":'
                         '{"value":"R-'), k, lit('"},"title":"X","employmentType":"CONTRACTOR","jobLocation":["Remote",{"address":"Paris"}]}},'
                                                 '{"@type":"JobPosting","identifier":'), k, lit(',"title":"Y"}]}'))
    broken = F.concat(lit('{"@type":"JobPosting","title":"'), k)
    plain = lit('{"@type":"Organization","name":"Acme"}')
    shape = (col("o_orderkey") % 5).cast("int")
    body = F.element_at(F.array(own, graph, items, broken, plain), shape + 1)
    html = F.concat(lit("<html><head><script type='application/ld+json'>"), body, lit('</script><script>var x={"@type":"JobPosting"};</script></head>'))
    return t.orders.select("o_orderkey", F.concat(lit("https://c"), _text(col("o_custkey")), lit(".example.com/careers#top")).alias("final_url"),
                           html.alias("html"))


@query("ld_blocks", "SELECT o_orderkey, 0::BIGINT AS block FROM orders WHERE o_orderkey % 5 <> 3")
def ld_blocks(t):
    """LD-1: readable JSON-LD blocks; broken ones and other scripts are skipped."""
    return LD.blocks(ld_pages(t), ["o_orderkey"]).select("o_orderkey", col("block").cast("bigint").alias("block"))


@query("ld_nodes", """
    SELECT o_orderkey, node, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority || '  Engineer' WHEN o_orderkey % 5 = 2 THEN CASE node WHEN 'i1' THEN 'X' ELSE 'Y' END
      WHEN node = 'g3' THEN o_orderpriority || ' 2' ELSE o_orderpriority END AS title
    FROM (SELECT *, unnest(CASE o_orderkey % 5 WHEN 0 THEN ['own'] WHEN 1 THEN ['g1', 'g2', 'g3'] WHEN 2 THEN ['i1', 'i2'] ELSE [] END) AS node FROM orders)""")
def ld_nodes(t):
    """LD-2: JobPosting nodes through lists, @graph, itemListElement and item, at any depth, in document order."""
    nodes = LD.postings(LD.blocks(ld_pages(t), ["o_orderkey"]), ["o_orderkey"])
    shape = col("o_orderkey") % 5
    path = col("path")
    name = (F.when(shape == 0, "own").when(shape == 1, F.when(path == "/0/000000001", "g1").when(path.startswith("/0/000000002/"), "g2").otherwise("g3"))
            .otherwise(F.when(path == "/1/000000000/2", "i1").otherwise("i2")))
    return nodes.select("o_orderkey", name.alias("node"), F.coalesce(J.scalar(J.get(col("posting"), "title")), J.scalar(J.get(col("posting"), "name"))).alias("title"))


_LD_SQL = f"""shapes AS (SELECT o_orderkey, 'https://c' || o_custkey || '.example.com' AS origin, {D.slug('o_orderpriority')} AS s, o_orderpriority AS p,
      strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 5 AS k FROM orders),
    ld AS (SELECT o_orderkey, 0 AS pos, 'Acme Inc' AS company, p || ' Engineer' AS title, origin || '/jobs/' || o_orderkey AS url, 'Berlin, BE, Germany' AS location,
      true AS remote, NULL AS department, day AS posted, 'FULL_TIME' AS employment_type, 'Berlin' AS city, 'BE' AS region, 'Germany' AS country FROM shapes WHERE k = 0
    UNION ALL SELECT o_orderkey, 0, NULL, p, origin || '/careers#job-' || s, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM shapes WHERE k = 1
    UNION ALL SELECT o_orderkey, 1, NULL, p, origin || '/careers#job-' || s || '-2', NULL, NULL, 'A | B', NULL, NULL, NULL, NULL, NULL FROM shapes WHERE k = 1
    UNION ALL SELECT o_orderkey, 2, NULL, p || ' 2', origin || '/careers#job-' || s || '-2-2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM shapes WHERE k = 1
    UNION ALL SELECT o_orderkey, 0, NULL, 'X', origin || '/careers#job-r-' || o_orderkey, 'Remote | Paris', NULL, NULL, NULL, 'CONTRACTOR', NULL, NULL, NULL FROM shapes WHERE k = 2
    UNION ALL SELECT o_orderkey, 1, NULL, 'Y', origin || '/careers#job-' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM shapes WHERE k = 2)"""


@query("ld_postings", f"WITH {_LD_SQL} SELECT o_orderkey, pos::BIGINT AS pos, company, title, url, location, remote, department, posted, employment_type, city, region, country FROM ld")
def ld_postings(t):
    """LD-3 / LD-4 / LD-5 / URL-8 / WIN-4: fields and addresses of embedded postings, fragments made unique per page."""
    p = LD.page_postings(ld_pages(t), "o_orderkey")
    return p.select("o_orderkey", col("pos").cast("bigint").alias("pos"), TX.clean(col("company")).alias("company"), TX.clean(col("title")).alias("title"),
                    "url", "location", "remote", "department", col("posted_text").alias("posted"), "employment_type", "city", "region", "country")


# ---- JSON a page loaded ----

def payloads(t):
    """One payload per order, in one of six shapes; a customer is a page."""
    k, pr = "\x01", "\x02"  # stand for the order's key and priority

    def repeat(make, n):
        return ",".join(make(i) for i in range(n))

    jobs = '{"meta":{"total":3},"result":{"jobs":[' + repeat(lambda i: (
        f'{{"jobId":"{k}-{i}","Title":"{pr} {i}","location":{{"city":"Berlin","state":"BE","country":"DE"}},"team":{{"name":"Core"}},'
        f'"createdAt":1700000000000,"isRemote":{"true" if i == 1 else "false"},"type":"Full-Time"}}'), 3) + "]}}"
    deep = '{"a":{"b":[[' + repeat(lambda i: (
        f'{{"name":"{pr}","url":"/jobs/{k}/{i}","city":"Lyon","country":"FR","department":["R","D","R"],"workplaceType":"Hybrid"}}'), 4) + "]]}}"
    filters = '{"filters":[' + repeat(lambda i: f'{{"id":"{k}{i}","name":"Engineering","count":{i + 1}}}', 5) + "]}"
    news = "[" + repeat(lambda i: f'{{"title":"News {k}","link":"/news/{i}","date":"2024-01-01"}}', 4) + "]"
    few = '{"jobs":[' + repeat(lambda i: f'{{"id":"{k}","title":"Only","location":"Rome"}}', 2) + "]}"
    mixed = '{"list":[' + repeat(lambda i: f'{{"id":"{k}m{i}","title":"Mixed {i}","team":"T"}}', 3) + ',{"x":1},{"y":2},"text"]}'
    shape = F.element_at(F.array(*[lit(x) for x in (jobs, deep, filters, news, few, mixed)]), (col("o_orderkey") % 6 + 1).cast("int"))
    keyed = F.replace(shape, lit(k), _text(col("o_orderkey")))
    body = F.when(F.contains(shape, lit(pr)), F.replace(keyed, lit(pr), col("o_orderpriority"))).otherwise(keyed)
    orders = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"))
    return orders.select("o_orderkey", "o_custkey", col("o_orderkey").alias("pos"), F.concat(lit("https://c"), _text(col("o_custkey")), lit(".example.com/careers")).alias("page_url"),
                           F.concat(lit("https://api.example.com/v1/"), _text(col("o_orderkey") % 6), lit("?page="), _text(col("o_orderkey"))).alias("url"), body.alias("body"))


@query("listing_arrays", """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'result.jobs' WHEN 1 THEN 'a.b[]' ELSE 'list' END AS path, CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END::BIGINT AS objects
    FROM orders WHERE o_orderkey % 6 IN (0, 1, 5)""")
def listing_arrays(t):
    """JS-1 / CLS-12 / AGG-15: arrays of postings, told from filters, news cards and short lists."""
    found = payloads(t).select("o_orderkey", F.inline(SN.listing_arrays(J.parse(col("body")), J.nesting(col("body")))))
    return found.select("o_orderkey", "path", F.size("objects").cast("bigint").alias("objects"))


_SNIFF = """items AS (SELECT o_custkey, o_orderkey, i AS item, o_orderkey % 6 AS k, o_orderpriority AS p,
      'https://c' || o_custkey || '.example.com' AS origin FROM orders, (SELECT unnest(range(4)) AS i)
      WHERE (o_orderkey % 6 IN (0, 5) AND i < 3) OR o_orderkey % 6 = 1),
    sizes AS (SELECT o_custkey, k, count(*) AS n, min(o_orderkey) AS f FROM items GROUP BY 1, 2),
    best AS (SELECT o_custkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM sizes) WHERE r = 1)"""


@query("sniffed_postings", f"""
    WITH {_SNIFF} SELECT o_custkey, CASE k WHEN 0 THEN p || ' ' || item WHEN 1 THEN p ELSE 'Mixed ' || item END AS title,
      CASE k WHEN 0 THEN origin || '/careers#job-' || o_orderkey || '-' || item WHEN 1 THEN origin || '/jobs/' || o_orderkey || '/' || item
        ELSE origin || '/careers#job-' || o_orderkey || 'm' || item END AS url,
      CASE k WHEN 0 THEN 'Berlin, BE, DE' WHEN 1 THEN 'Lyon, FR' END AS location, CASE WHEN k = 0 AND item = 1 THEN true END AS remote,
      CASE k WHEN 0 THEN 'Core' WHEN 1 THEN 'R | D' ELSE 'T' END AS department, CASE k WHEN 0 THEN 'Full-Time' END AS employment_type,
      CASE k WHEN 1 THEN 'Hybrid' END AS workplace, CASE k WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Lyon' END AS city, CASE k WHEN 0 THEN 'BE' END AS region,
      CASE k WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' END AS country, CASE k WHEN 0 THEN make_timestamp(1700000000000000) END AS posted
    FROM items JOIN best USING (o_custkey, k)""")
def sniffed_postings(t):
    """JS-2 / JS-3 / JS-4 / JS-5: postings of the largest listing each page loaded, pages of one endpoint merged."""
    rows = SN.sniffed_postings(payloads(t).withColumn("data", J.parse(col("body"))), "o_custkey")
    return rows.select("o_custkey", "title", "url", "location", "remote", "department", "employment_type", "workplace", "city", "region", "country",
                       utc(col("posted")).alias("posted"))


@query("payload_profile", """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'meta,result' WHEN 1 THEN 'a' WHEN 2 THEN 'filters' WHEN 4 THEN 'jobs' WHEN 5 THEN 'list' END AS keys,
      CASE o_orderkey % 6 WHEN 0 THEN 'result.jobs=3' WHEN 1 THEN 'a.b=1,a.b[]=4,a.b[][].department=3' WHEN 2 THEN 'filters=5' WHEN 3 THEN '[]=4' WHEN 4 THEN 'jobs=2' ELSE 'list=6' END AS arrays FROM orders""")
def payload_profile(t):
    """JS-6: what each payload holds."""
    p = SN.payload_profile(payloads(t).withColumn("data", J.parse(col("body"))), ["o_orderkey"])
    arrays = F.transform("arrays", lambda a: F.concat(a["path"], lit("="), a["size"].cast("string")))
    return p.select("o_orderkey", F.array_join("keys", ",").alias("keys"), F.array_join(arrays, ",").alias("arrays"))


HOSTS = ["api.example.com", "x.greenhouse.io", "tracker.net", "careers.example.com", "lever.co", "notlever.co", "boards.personio.de"]


@query("captured_responses", f"""
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders
      WHERE {D.pick(HOSTS, 'o_orderkey')} NOT IN ('tracker.net', 'notlever.co')) WHERE o_orderkey % 4 <> 3""")
def captured_responses(t):
    """JS-7: responses worth reading, empty ones left out."""
    r = t.orders.select("o_custkey", "o_orderkey", col("o_orderkey").alias("pos"), F.concat(lit("https://c"), _text(col("o_custkey")), lit(".example.com/x")).alias("page_url"),
                        F.concat(lit("https://"), pick(HOSTS, col("o_orderkey")), lit("/jobs")).alias("url"), F.when(col("o_orderkey") % 4 == 3, "").otherwise("{}").alias("body"))
    return SN.captured(r, "page_url").select("o_custkey", "o_orderkey")


@query("json_properties", """
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k') AS text FROM events""")
def json_properties(t):
    """SRC-2 / JS-2: values looked up in JSON of unknown shape, any spelling of the key."""
    e = t.events.select("event_id", J.lowered(J.parse(col("props"))).alias("entries"))
    v = J.first_of(col("entries"), ["missing", "K"])
    return e.select("event_id", J.number(v).cast("bigint").alias("k"), J.readable(v).alias("text"))


# ---- hiring platforms ----

LINKS = [
    '<a href="https://boards.greenhouse.io/acme/jobs/1?gh_jid=1">x</a><script src="https://boards.greenhouse.io/embed/job_board/js?for=Acme"></script>',
    '<a href="https:\\/\\/jobs.lever.co\\/Globex">x</a> https://jobs.eu.lever.co/globex/1 <p>icims.com</p>',
    '<a href="https://jobs.ashbyhq.com/Initech%20Co">x</a><a href="https://api.ashbyhq.com/posting-api/job-board/embed">y</a>',
    '<a href="https://careers.smartrecruiters.com/Hooli">x</a> https://hooli.wd5.myworkdayjobs.com/en-US/External/job/1',
    '<a href="https://eabc.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs">x</a> https://eabc.fa.us2.oraclecloud.com/hcmUI/sign-in',
    "<p>nothing</p> https://acme.taleo.net/login https://acme.taleo.net/careersection/jobs/ apply.workable.com",
    "https://jobs.lever.co/v0 https://x.wd1.myworkdayjobs.com/login https://boards.greenhouse.io/jobs/"]
# what each of these holds: (index, order, ats, token)
HITS = [(0, 1, "greenhouse", "Acme"), (0, 2, "greenhouse", "acme"), (1, 1, "lever", "Globex"), (1, 2, "lever", "globex"), (2, 1, "ashby", "initech co"),
        (3, 1, "smartrecruiters", "Hooli"), (3, 2, "workday", "hooli/External"), (4, 1, "oracle", "eabc.fa.us2.oraclecloud.com/CX_1")]
_HITS_SQL = f"""h(i, n, ats, token) AS (VALUES {', '.join(str(h) for h in HITS)}),
    m AS (SELECT 'c' || o_custkey AS domain, o_orderkey, n, ats, token FROM orders JOIN h ON h.i = o_orderkey % {len(LINKS)}),
    d AS (SELECT domain, ats, lower(token) AS key, count(*) AS hits, arg_min(token, (o_orderkey, n)) AS token, min((o_orderkey, n)) AS f FROM m GROUP BY 1, 2, 3)"""


def linked_pages(t):
    none = lit(None).cast("array<string>")
    url = F.concat(lit("https://c"), _text(col("o_custkey")), lit(".example.com/"))
    return spread(t.orders.select("o_orderkey", "o_custkey")).select(F.concat(lit("c"), _text(col("o_custkey"))).alias("domain"), col("o_orderkey").alias("pos"), url.alias("url"), url.alias("final_url"),
                           none.alias("json_urls"), pick(LINKS, col("o_orderkey")).alias("html"))


SLUGS = ["acme", "globex", "initech", "hooli", "zz"]


@query("board_detections", f"""
    WITH {_HITS_SQL}, s AS (SELECT 'c' || c_custkey AS domain, {D.pick(SLUGS, 'c_custkey')} AS slug FROM customer),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY domain ORDER BY hits + CASE WHEN {D.names_match("split_part(token, '/', 1)", 'slug')} THEN 1000 ELSE 0 END DESC, f) AS rank
      FROM d LEFT JOIN s USING (domain))
    SELECT domain, rank, ats, token, hits::BIGINT AS hits, CASE ats WHEN 'workday' THEN 'hooli wd5 External' WHEN 'oracle' THEN 'eabc.fa.us2.oraclecloud.com en CX_1' END AS extra
    FROM r WHERE rank <= 3""")
def board_detections(t):
    """ATS-1 / ATS-2 / AGG-10: boards per company, counted, ranked, best three."""
    sites = t.customer.select(F.concat(lit("c"), _text(col("c_custkey"))).alias("domain"), pick(SLUGS, col("c_custkey")).alias("slug"))
    x = col("extra")
    extra = (F.when(col("ats") == "workday", F.concat_ws(" ", x["tenant"], x["wd"], x["site"]))
             .when(col("ats") == "oracle", F.concat_ws(" ", x["host"], x["lang"], x["site"])))
    return B.detections(linked_pages(t), sites, top=3).select("domain", col("rank").cast("bigint").alias("rank"), "ats", "token", "hits", extra.alias("extra"))


_N = len(LINKS)


@query("unsupported_vendors", f"""
    WITH f AS (SELECT 'c' || o_custkey AS domain, o_orderkey % {_N} AS i FROM orders)
    SELECT domain, array_to_string(list_filter([CASE WHEN bool_or(i = 1) THEN 'icims' END, CASE WHEN bool_or(i = 5) THEN 'taleo' END, CASE WHEN bool_or(i = 5) THEN 'workable' END],
      lambda v: v IS NOT NULL), ',') AS vendors, bool_or(i = 0) AS saw_gh_jid FROM f GROUP BY domain""")
def unsupported_vendors(t):
    """ATS-3 / ATS-4 / SET-3: platforms without a reader, minus those we read; gh_jid seen."""
    return B.unsupported_vendors(linked_pages(t)).select("domain", F.array_join("vendors", ",").alias("vendors"), "saw_gh_jid")


@query("vendor_links", f"""
    SELECT DISTINCT 'c' || o_custkey AS domain, v AS vendor, u AS url FROM orders JOIN (VALUES
      (4, 'oracle', 'https://eabc.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs'), (5, 'taleo', 'https://acme.taleo.net/careersection/jobs/')) x(i, v, u)
    ON i = o_orderkey % {_N}""")
def vendor_links(t):
    """ATS-5: the address to send a person to: the job search, not a sign-in page."""
    return B.vendor_links(linked_pages(t))


@query("guessed_boards", """
    WITH g AS (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats, o_orderstatus = 'P' AND o_orderkey % 3 = 1 AS own, o_custkey % 4 = 0 AND o_orderkey % 3 = 2 AS named FROM orders),
    j AS (SELECT o_custkey, ats, bool_or(own OR named) AS ok, count(*) AS jobs FROM g GROUP BY 1, 2)
    SELECT 'c' || o_custkey AS domain, ats, jobs::BIGINT AS jobs FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE ats WHEN 'greenhouse' THEN 1 WHEN 'lever' THEN 2 ELSE 3 END) AS r FROM j WHERE ok) WHERE r = 1""")
def guessed_boards(t):
    """ATS-6: boards found by guessing are kept only when they are the company's."""
    k, c = col("o_orderkey") % 3, F.concat(lit("c"), _text(col("o_custkey")))
    url = F.when((col("o_orderstatus") == "P") & (k == 1), F.concat(lit("https://jobs."), c, lit(".com/1"))).otherwise(lit("https://board.io/1"))
    guesses = t.orders.select(c.alias("domain"), F.element_at(F.array(lit("greenhouse"), lit("lever"), lit("ashby")), (k + 1).cast("int")).alias("ats"),
                              F.when((col("o_custkey") % 4 == 0) & (k == 2), F.concat(lit("Customer "), c, lit(" Jobs"))).otherwise("Other").alias("board_name"), url.alias("url"))
    sc = F.concat(lit("c"), _text(col("c_custkey")))
    sites = t.customer.select(sc.alias("domain"), F.concat(lit("customer"), sc).alias("slug"), F.array(F.concat(sc, lit(".com"))).alias("domains"))
    return B.confirmed_guesses(guesses, sites)


# ---- feeds ----

def _responses(t, ats, body, endpoint, token=None, offset=None, status=200):
    return t.orders.select("o_orderkey", F.concat(lit("c"), _text(col("o_custkey"))).alias("domain"), lit(ats).alias("ats"),
                           (token if token is not None else _text(col("o_orderkey"))).alias("token"), lit(endpoint).alias("endpoint"),
                           (lit(0) if offset is None else offset).alias("page_offset"), lit(status).alias("status"), body.alias("body"))


_FEED_COLS = ["token", "company", "title", "url", "location", "department", "posted", "workplace", "employment_type", "city", "region", "country"]


def _shown(feed):
    return feed.withColumn("posted", utc(col("posted"))).select(*_FEED_COLS)


@query("feed_greenhouse", """
    SELECT o_orderkey::VARCHAR AS token, CASE WHEN o_orderstatus = 'F' THEN 'Acme' END AS company, o_orderpriority AS title, 'https://x.io/jobs/' || o_orderkey AS url,
      'Berlin, Germany' AS location, CASE WHEN o_orderkey % 2 = 0 THEN 'Eng' END AS department,
      CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2024-01-02 03:04:05' ELSE o_orderdate END AS posted, CASE WHEN o_orderkey % 3 = 0 THEN 'Hybrid' END AS workplace,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Full-time' END AS employment_type, NULL AS city, NULL AS region, NULL AS country FROM orders""")
def feed_greenhouse(t):
    """RD-1 / JOIN-6: jobs, their first department, custom fields by name."""
    k = col("o_orderkey")
    meta = F.when(k % 3 == 0, lit('[{"name":"Workplace Type","value":"Hybrid"},{"name":"Employment Type","value":"Full-time"},{"name":"Remote?","value":true}]')).otherwise("null")
    job = F.concat(lit('{"id":'), _text(k), lit(',"title":"'), col("o_orderpriority"), lit('","absolute_url":"https://x.io/jobs/'), _text(k), lit('","location":{"name":" Berlin,  Germany"},"updated_at":"'),
                   F.when(col("o_orderstatus") == "O", lit("2024-01-02T03:04:05Z")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
                   F.when(col("o_orderstatus") == "F", lit('","company_name":"Acme","metadata":')).otherwise(lit('","metadata":')), meta, lit("}"))
    jobs = _responses(t, "greenhouse", F.concat(lit('{"jobs":['), job, lit("]}")), "jobs")
    dept = F.concat(lit('{"departments":[{"name":"No Department","jobs":[{"id":'), _text(k), lit("}]},{\"name\":\"Eng\",\"jobs\":[{\"id\":"), _text(F.when(k % 2 == 0, k).otherwise(-1)),
                    lit('}]},{"name":"Later","jobs":[{"id":'), _text(F.when(k % 2 == 0, k).otherwise(-1)), lit("}]}]}"))
    return _shown(RD.greenhouse(jobs.unionByName(_responses(t, "greenhouse", dept, "departments"))))


@query("feed_lever", """
    SELECT o_orderkey::VARCHAR AS token, NULL AS company, o_orderpriority AS title, 'https://jobs.lever.co/a/' || o_orderkey AS url,
      CASE WHEN o_orderkey % 2 = 0 THEN 'London | Paris' ELSE 'Oslo' END AS location, CASE WHEN o_orderkey % 3 = 0 THEN 'Dept' ELSE 'Team' END AS department,
      o_orderdate AS posted, 'hybrid' AS workplace, 'Intern' AS employment_type, NULL AS city, NULL AS region, 'GB' AS country FROM orders""")
def feed_lever(t):
    """RD-2: several locations, department before team, milliseconds."""
    k = col("o_orderkey")
    body = F.concat(lit('[{"text":"'), col("o_orderpriority"), lit('","hostedUrl":"https://jobs.lever.co/a/'), _text(k), lit('","categories":{"location":"Oslo",'),
                    F.when(k % 2 == 0, lit('"allLocations":["London","Paris","London"],')).otherwise(""), F.when(k % 3 == 0, lit('"department":"Dept",')).otherwise(""),
                    lit('"team":"Team","commitment":"Intern"},"workplaceType":"hybrid","country":"GB","createdAt":'),
                    _text(F.unix_millis(col("o_orderdate").cast("timestamp"))), lit("}]"))
    return _shown(RD.lever(_responses(t, "lever", body, "postings")))


@query("feed_ashby", """
    SELECT o_orderkey::VARCHAR AS token, NULL AS company, o_orderpriority AS title, 'https://jobs.ashbyhq.com/a/' || o_orderkey AS url, 'New York | Remote' AS location,
      'Eng' AS department, o_orderdate AS posted, 'Hybrid' AS workplace, 'FullTime' AS employment_type, 'New York' AS city, 'NY' AS region, 'USA' AS country
    FROM orders WHERE o_orderkey % 5 <> 0""")
def feed_ashby(t):
    """RD-3: unlisted rows dropped, postal address, workplaceType rather than isRemote."""
    k = col("o_orderkey")
    body = F.concat(lit('{"jobs":[{"title":"'), col("o_orderpriority"), lit('","jobUrl":"https://jobs.ashbyhq.com/a/'), _text(k), lit('","isRemote":true,"location":"New York",'
                    '"secondaryLocations":[{"location":"Remote"}],"team":"Eng","workplaceType":"Hybrid","employmentType":"FullTime","address":{"postalAddress":{"addressLocality":"New York",'
                    '"addressRegion":"NY","addressCountry":"USA"}},"publishedAt":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.000+00:00'"),
                    F.when(k % 5 == 0, lit('","isListed":false}]}')).otherwise(lit('"}]}')))
    return _shown(RD.ashby(_responses(t, "ashby", body, "board")))


SLUG_PLACES = [("South-Africa-Cape-Town", "Cape Town", None, "ZA"), ("Boise", None, None, None), ("US-WA-Spokane", "Spokane", "WA", "US"), ("FR-Nantes", "Nantes", None, "FR"),
               ("Onsite", None, None, None), ("QQ-Lund", None, None, None), ("CA-BC-Hybrid", None, "BC", "CA"), ("Portugal", None, None, "PT"),
               ("Chad-Valley", None, None, None), ("MT-Missoula", None, None, None), ("New-Zealand-Remote", None, None, "NZ")]
_SL = [D.pick([x[i] for x in SLUG_PLACES], "o_orderkey") for i in range(4)]


@query("feed_workday", f"""
    SELECT 'acme/Ext' || o_orderkey AS token, NULL AS company, o_orderpriority AS title, 'https://acme.wd1.myworkdayjobs.com/Ext' || o_orderkey || '/job/' || {_SL[0]} || '/T_R' || o_orderkey AS url,
      CASE WHEN o_orderkey % 2 = 0 THEN replace({_SL[0]}, '-', ' ') || ' (+3 more)' ELSE 'Austin, Texas' END AS location, NULL AS department,
      TIMESTAMP '2024-03-10' - INTERVAL 30 DAY AS posted, 'Hybrid' AS workplace, NULL AS employment_type, {_SL[1]} AS city, {_SL[2]} AS region, {_SL[3]} AS country FROM orders""")
def feed_workday(t):
    """RD-4 / RD-5: 'N Locations', relative dates, places read from the path."""
    k = col("o_orderkey")
    body = F.concat(lit('{"total":1,"jobPostings":[{"title":"'), col("o_orderpriority"), lit('","externalPath":"/job/'), pick([x[0] for x in SLUG_PLACES], k), lit("/T_R"), _text(k),
                    F.when(k % 2 == 0, lit('","locationsText":"4 Locations"')).otherwise(lit('","locationsText":"Austin, Texas"')), lit(',"postedOn":"Posted 30+ Days Ago","remoteType":"Hybrid"}]}'))
    responses = _responses(t, "workday", body, "acme.wd1.myworkdayjobs.com", token=F.concat(lit("acme/Ext"), _text(k)))
    return _shown(RD.workday(responses, gazetteer(t.spark), F.expr("TIMESTAMP_NTZ '2024-03-10 15:00:00'")))


FLAGS = [('"remote":true,"hybrid":false', "remote"), ('"remote":false,"hybrid":true', "hybrid"), ('"remote":false,"hybrid":false', "onsite"), ('"x":1', None)]


@query("feed_smartrecruiters", f"""
    SELECT o_orderkey::VARCHAR AS token, CASE WHEN o_orderkey % 2 = 0 THEN 'Hooli' END AS company, o_orderpriority AS title, 'https://jobs.smartrecruiters.com/' || o_orderkey || '/p' || o_orderkey AS url,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Lyon, Rhône, France' ELSE 'Lyon | fr' END AS location, 'Eng' AS department, o_orderdate AS posted, {D.pick([f[1] for f in FLAGS], 'o_orderkey')} AS workplace,
      'permanent' AS employment_type, 'Lyon' AS city, 'Rhône' AS region, 'fr' AS country FROM orders""")
def feed_smartrecruiters(t):
    """RD-6: hybrid before remote; flags present and off mean on-site; presence itself counts."""
    k = col("o_orderkey")
    body = F.concat(lit('{"totalFound":1,"content":[{"id":"p'), _text(k), lit('","name":"'), col("o_orderpriority"), F.when(k % 2 == 0, lit('","company":{"name":"Hooli"}')).otherwise(lit('"')),
                    lit(',"location":{"city":"Lyon","region":"Rhône","country":"fr",'), F.when(k % 3 == 0, lit('"fullLocation":"Lyon, Rhône, France",')).otherwise(""), pick([f[0] for f in FLAGS], k),
                    lit('},"department":{"label":"Eng"},"typeOfEmployment":{"id":"permanent"},"createdOn":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), lit('"}]}'))
    return _shown(RD.smartrecruiters(_responses(t, "smartrecruiters", body, "postings")))


@query("feed_oracle", """
    SELECT 'h.fa.oraclecloud.com/CX' || o_orderkey AS token, NULL AS company, o_orderpriority AS title, 'https://h.fa.oraclecloud.com/hcmUI/CandidateExperience/fr/sites/CX' || o_orderkey || '/job/' || o_orderkey AS url,
      'Oslo | A | B | C | D | E' AS location, CASE WHEN o_orderkey % 2 = 0 THEN 'Func' ELSE 'Org' END AS department, o_orderdate AS posted, NULL AS workplace, 'Regular' AS employment_type,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Oslo' END AS city, CASE WHEN o_orderkey % 3 = 0 THEN 'Oslo fylke' END AS region, 'NO' AS country FROM orders WHERE o_orderkey % 7 <> 0""")
def feed_oracle(t):
    """RD-7: all further locations, first non-empty of several fields, rows without an id dropped."""
    k = col("o_orderkey")
    body = F.concat(lit('{"items":[{"TotalJobsCount":1,"requisitionList":[{"Id":'), F.when(k % 7 == 0, lit("null")).otherwise(F.concat(lit('"'), _text(k), lit('"'))), lit(',"Title":"'), col("o_orderpriority"),
                    lit('","PostedDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), lit('","PrimaryLocation":"Oslo","PrimaryLocationCountry":"NO","WorkplaceType":"","JobSchedule":"","WorkerType":"Regular",'
                    '"secondaryLocations":[{"Name":"A"},{"Name":"B"},{"Name":"C"},{"Name":"D"},{"Name":"E"}],"JobFamily":"",'), F.when(k % 2 == 0, lit('"JobFunction":"Func",')).otherwise(""), lit('"Organization":"Org","workLocation":['),
                    F.when(k % 3 == 0, lit('{},{"TownOrCity":"Oslo","Region2":"Oslo fylke","Country":"NO"}')).otherwise(""), lit("]}]}]}"))
    return _shown(RD.oracle(_responses(t, "oracle", body, "fr", token=F.concat(lit("h.fa.oraclecloud.com/CX"), _text(k)))))


# ---- paged boards ----

def line_pages(t):
    """Each order is a board, each line number one page of it: the lines of that number. Line 5 could not be read."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list("l_partkey")).alias("items"), F.count("*").alias("n"))
    total = lines.groupBy("l_orderkey").agg(F.sum("n").alias("total"))
    key = _text(col("l_orderkey"))
    return lines.join(total, "l_orderkey").select(
        key.alias("domain"), lit("x").alias("ats"), key.alias("token"), (col("l_linenumber") - 1).cast("int").alias("page_offset"),
        F.when(col("l_linenumber") == 1, col("total")).otherwise(0).alias("total"), F.when(col("l_linenumber") != 5, col("items")).alias("items"))


_LINES = """n AS (SELECT l_orderkey, l_linenumber - 1 AS page_offset, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) - 1 AS pos FROM lineitem WHERE l_linenumber <> 5),
    w AS (SELECT l_orderkey, count(*) AS wanted FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1)"""


@query("board_rows", f"""
    WITH {_LINES} SELECT l_orderkey::VARCHAR AS domain, page_offset::BIGINT AS page_offset, pos::BIGINT AS pos, l_partkey AS item FROM (SELECT n.*, wanted, row_number() OVER (PARTITION BY l_orderkey ORDER BY page_offset, pos) AS k
      FROM n JOIN w USING (l_orderkey) WHERE page_offset < wanted) WHERE k <= wanted""")
def board_rows(t):
    """SRC-4 / FLT-6: pages in order, the total from the first page alone, rows up to that total."""
    return apis.board_rows(line_pages(t)).select("domain", col("page_offset").cast("bigint").alias("page_offset"), col("pos").cast("bigint").alias("pos"), "item")


@query("board_truncation", f"""
    WITH {_LINES} SELECT l_orderkey::VARCHAR AS domain, wanted::BIGINT AS wanted, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(range(1, wanted)) AS o) x
        WHERE o NOT IN (SELECT page_offset FROM n n2 WHERE n2.l_orderkey = w.l_orderkey)) THEN 'a results page could not be read' END AS truncated FROM w""")
def board_truncation(t):
    """SRC-5: why a board was not read whole; this gates closing."""
    return apis.truncation(line_pages(t), page_size=1).select("domain", col("wanted").cast("bigint").alias("wanted"), "truncated")


# ---- one record for every source ----

@query("conformed_postings", f"""
    SELECT o_orderkey, company, title, 'https://x.io/' || o_orderkey AS url, location, workplace = 'remote' AS remote, 'Eng' AS department, o_orderdate AS posted, 'lever' AS source, workplace,
      {D.employment_type_of('et')} AS employment_type, city, region, country, geo_confidence
    FROM (SELECT *, 'Acme' AS company, o_orderpriority || CASE WHEN o_orderkey % 4 = 1 THEN ' (Hybrid)' ELSE '' END AS title, {D.pick(['Contract', 'full_time', None, 'PER_DIEM'], 'o_orderkey')} AS et,
      CASE o_orderkey % 5 WHEN 0 THEN 'San Francisco, CA' WHEN 1 THEN 'Remote - US' WHEN 2 THEN 'Paris' WHEN 3 THEN 'Lyon, France' ELSE NULL END AS location,
      coalesce({D.workplace_of(D.pick(['onsite', None, 'Flex'], 'o_orderkey'))}, CASE WHEN o_orderkey % 7 = 0 THEN 'remote' WHEN o_orderkey % 7 = 1 THEN 'onsite' END,
        CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'hybrid' WHEN o_orderkey % 5 = 1 THEN 'remote' END) AS workplace,
      CASE o_orderkey % 5 WHEN 0 THEN 'San Francisco' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Lyon' END END AS city,
      CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'California' ELSE NULL END END AS region,
      CASE WHEN o_orderkey % 2 = 1 THEN 'DE' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'US' WHEN 3 THEN 'FR' END END AS country,
      CASE WHEN o_orderkey % 2 = 1 THEN 'feed' WHEN o_orderkey % 5 IN (0, 1, 3) THEN 'parsed' END AS geo_confidence FROM orders)""".replace(
    "CASE o_orderkey % 5 WHEN 0 THEN 'San Francisco' WHEN 3", "CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'San Francisco' END WHEN 3"))
def conformed_postings(t):
    """PRJ-1 / CLS-3: any feed row -> the fixed posting record."""
    k = col("o_orderkey")
    feed = t.orders.select(
        "o_orderkey", lit("  Acme ").alias("company"), F.concat("o_orderpriority", F.when(k % 4 == 1, lit("  (Hybrid)")).otherwise("")).alias("title"),
        F.concat(lit("https://x.io/"), _text(k)).alias("url"), pick(["San Francisco, CA", "Remote - US", "Paris", " Lyon,  France", ""], k).alias("location"),
        F.when(k % 7 == 0, lit(True)).when(k % 7 == 1, lit(False)).alias("remote"), lit("Eng").alias("department"), col("o_orderdate").alias("posted"), lit("lever").alias("source"),
        pick(["onsite", None, "Flex"], k).alias("workplace"), pick(["Contract", "full_time", None, "PER_DIEM"], k).alias("employment_type"),
        lit(None).cast("string").alias("city"), lit(None).cast("string").alias("region"), F.when(k % 2 == 1, "Germany").alias("country"))
    return CF.conform(feed, gazetteer(t.spark))


@query("complete_rows", f"""
    SELECT page_id, {D.url_key('url')} AS url_key FROM (SELECT *, row_number() OVER (PARTITION BY {D.url_key('url')} ORDER BY page_id) AS k FROM pages WHERE {D.page_title('html')} <> '') WHERE k = 1""")
def complete_rows(t):
    """FLT-5 / WIN-3: rows with a title and a link, the first per URL key."""
    p = t.pages.select("page_id", "url", C.page_title(col("html")).alias("title"))
    return CF.dedupe(p, [], [col("page_id")]).select("page_id", "url_key")


@query("reader_cascade", """
    WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS p, o_orderstatus <> 'P' AS has FROM orders)
    SELECT 'c' || o_custkey AS domain, p AS priority, o_orderkey FROM f JOIN (SELECT o_custkey, min(p) AS p FROM f GROUP BY 1) b USING (o_custkey, p) WHERE has""")
def reader_cascade(t):
    """RD-8: the first reader that found a board settles the company, even when the board is empty."""
    p = col("o_orderpriority")
    found = t.orders.select("o_orderkey", F.concat(lit("c"), _text(col("o_custkey"))).alias("domain"),
                            F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3).otherwise(4).alias("priority"),
                            F.when(col("o_orderstatus") != "P", F.concat(lit("https://x/"), _text(col("o_orderkey")))).alias("url"))
    return CA.first_that_yields(found).select("domain", "priority", "o_orderkey")


@query("generic_merge", """
    WITH l AS (SELECT l_orderkey, l_partkey FROM lineitem)
    SELECT 'c' || l_orderkey AS domain, CASE WHEN p_size > 20 THEN 'Detail ' || p_name ELSE 'Link ' || l_partkey END AS title, CASE WHEN p_size > 20 THEN 'json-ld' ELSE 'html-heuristic' END AS source
    FROM l JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'c' || o_orderkey, 'Embedded', 'json-ld' FROM orders WHERE o_orderstatus = 'P'""")
def generic_merge(t):
    """RD-9 / JOIN-11 / SET-1: embedded postings plus links, each link read from its own page where there is one."""
    embedded = t.orders.filter(col("o_orderstatus") == "P").select(F.concat(lit("c"), _text(col("o_orderkey"))).alias("domain"), lit("Embedded").alias("title"), lit("u").alias("url"),
                                                                  lit(None).cast("string").alias("location"), lit("json-ld").alias("source"))
    links = t.lineitem.join(t.part, col("l_partkey") == col("p_partkey")).select(
        F.concat(lit("c"), _text(col("l_orderkey"))).alias("domain"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("url_key"),
        F.concat(lit("Link "), _text(col("l_partkey"))).alias("title"), lit(None).cast("string").alias("location")).withColumn("url", col("url_key"))
    details = t.lineitem.join(t.part.filter(col("p_size") > 20), col("l_partkey") == col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("url_key"), F.concat(lit("Detail "), "p_name").alias("title"),
        lit("d").alias("url"), lit(None).cast("string").alias("location"), lit("json-ld").alias("source"))
    return CA.merge_generic(embedded, links, details).select("domain", "title", "source")


@query("trusted_results", """
    WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority > '2' OR o_custkey % 3 = 0 THEN 'html-heuristic' ELSE 'json-ld' END AS source FROM orders)
    SELECT o_custkey, o_orderkey, source FROM p WHERE NOT (o_custkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM p GROUP BY 1 HAVING bool_and(source = 'html-heuristic')))""")
def trusted_results(t):
    """RD-10: link guesses are not believed where an unreadable platform is behind the company."""
    p = t.orders.select(col("o_custkey").alias("domain"), "o_orderkey", F.when((col("o_orderpriority") > "2") | (col("o_custkey") % 3 == 0), "html-heuristic").otherwise("json-ld").alias("source"))
    vendors = t.customer.select(col("c_custkey").alias("domain"), F.when(col("c_custkey") % 2 == 0, F.array(lit("taleo"))).otherwise(F.array().cast("array<string>")).alias("vendors"))
    return CA.trusted(p, vendors).select(col("domain").alias("o_custkey"), "o_orderkey", "source")


@query("proper_company_name", f"""
    WITH p AS (SELECT o_custkey, o_orderkey, {D.pick(['Acme Corp', 'Acme', 'ACME Inc', 'Globex', None], 'o_orderkey')} AS company FROM orders),
    b AS (SELECT o_custkey, company FROM (SELECT o_custkey, company, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS k
      FROM p WHERE company <> 'Acme' AND {D.names_match('company', "'acme'")} GROUP BY 1, 2) WHERE k = 1)
    SELECT o_orderkey, coalesce(b.company, p.company) AS company FROM p LEFT JOIN b USING (o_custkey)""")
def proper_company_name(t):
    """RD-11: a batch takes the company's own most common spelling."""
    p = t.orders.select(col("o_custkey").alias("run_id"), col("o_custkey").alias("domain"), "o_orderkey", col("o_orderkey").alias("pos"), pick(["Acme Corp", "Acme", "ACME Inc", "Globex", None], col("o_orderkey")).alias("company"))
    sites = t.customer.select(col("c_custkey").alias("domain"), lit("Acme").alias("name"), lit("acme").alias("slug"))
    return CA.proper_company_name(p, sites).select("o_orderkey", "company")


@query("adapter_rows", f"""
    WITH {_SNIFF} SELECT o_custkey AS domain, 'sniffed' AS reader, count(*)::BIGINT AS postings FROM items JOIN best USING (o_custkey, k) WHERE o_custkey % 10 <> 0 GROUP BY 1
    UNION ALL SELECT o_custkey, 'own', count(*) FROM orders WHERE o_custkey % 10 = 0 AND o_custkey IN (10, 20) GROUP BY 1
    UNION ALL SELECT o_custkey, 'sniffed', count(*) FROM items JOIN best USING (o_custkey, k) WHERE o_custkey % 10 = 0 AND o_custkey NOT IN (10, 20) GROUP BY 1""")
def adapter_rows(t):
    """UDF-2 / UDF-3: a company's own reader goes first, the generic one serves the rest."""
    def own(p):
        return p.select("domain", lit("own").alias("reader"))

    def generic(p):
        return SN.sniffed_postings(p.withColumn("data", J.parse(col("body"))), "domain").select("domain", lit("sniffed").alias("reader"))

    rows = RD.with_adapters(payloads(t).withColumnRenamed("o_custkey", "domain"), {10: own, 20: own}, generic)
    return rows.groupBy("domain", "reader").agg(F.count("*").alias("postings"))


# ---- pages in, postings out ----

_SITE = 4           # postings on a result page
_IDS = 1_000_000    # addresses of postings hold long numbers


def _crawled(t):
    """A careers site per customer, as landed: result pages that name only the next one, and a page for most postings.

    Result pages list four orders each and repeat the first one's link; customers divisible by 5 list two, so their further
    pages are not followed. A third of the posting pages never landed, a third holds no posting of its own.
    """
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"))
    size = F.when(col("o_custkey") % 5 == 0, 2).otherwise(_SITE)
    o = o.withColumn("page", F.ceil(col("r") / size).cast("int"))
    site = F.concat(lit("https://c"), _text(col("o_custkey")), lit(".example.com"))
    link = F.concat(lit('<a href="/jobs/'), _text(col("o_orderkey") + _IDS), lit('">Post '), _text(col("o_orderkey")), lit("</a>"))
    listing = o.groupBy("o_custkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", link.alias("a")))), lambda x: x["a"]), " ").alias("links"))
    first = o.filter("r = 1").select("o_custkey", F.concat(lit('<a href="/jobs/'), _text(col("o_orderkey") + _IDS), lit('">Seen before</a>')).alias("again"))
    embedded = F.when(col("o_custkey") % 4 == 0, F.concat(
        lit('<script type="application/ld+json">{"@type":"JobPosting","title":"On page '), _text(col("page")), lit('","url":"/own/'), _text(col("page")), lit('"}</script>'))).otherwise("")
    more = F.concat(lit('<a href="/careers?page='), _text(col("page") + 1), lit('">next</a>'))
    listing = listing.join(first, "o_custkey").select(
        "o_custkey", F.concat(site, lit("/careers"), F.when(col("page") == 1, "").otherwise(F.concat(lit("?page="), _text(col("page"))))).alias("url"),
        F.concat(lit("<html><body>"), embedded, "links", F.when(col("page") > 1, col("again")).otherwise(""), more).alias("html"))
    detail = F.when(col("o_orderkey") % 3 == 1, F.concat(
        lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Detail '), "o_orderpriority", lit('"}</script>'))).otherwise("<p>Apply here</p>")
    details = o.filter("o_orderkey % 3 <> 0").select("o_custkey", F.concat(site, lit("/jobs/"), _text(col("o_orderkey") + _IDS)).alias("url"), detail.alias("html"))
    pages = listing.unionByName(details)
    return pages.select(F.concat(lit("c"), _text(col("o_custkey"))).alias("domain"), "url", col("url").alias("final_url"), "html",
                        F.array(U.registrable_domain(U.host(col("url")))).alias("domains"))


def _read_sites(t, upto=None):
    # what the crawl landed lies in a table; it is not made anew for every reading
    pages = kept(_crawled(t), f"{shared_folder(t.spark)}/crawled-{uuid.uuid4().hex}", "pages")
    landed = RG.LandedPages(pages, upto)
    starts = pages.filter(F.col("url").endswith("/careers")).select("domain", "url", lit(1).alias("rank"))
    return landed, landed.listings(starts)


_SITES = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    placed AS (SELECT *, CASE WHEN c % 5 = 0 THEN 2 ELSE 4 END AS size, (r + CASE WHEN c % 5 = 0 THEN 1 ELSE 3 END) // CASE WHEN c % 5 = 0 THEN 2 ELSE 4 END AS page FROM o),
    pages AS (SELECT c, page, count(*) AS own, CASE WHEN page > 1 THEN 1 ELSE 0 END AS again FROM placed GROUP BY c, page),
    -- a page is reached if every page before it has three links
    reached AS (SELECT c, page, own + again AS links FROM pages a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.c = a.c AND b.page < a.page AND b.own + b.again < 3)),
    shown AS (SELECT p.* FROM placed p JOIN reached USING (c, page))"""


@query("generic_reading", f"""
    WITH {_SITES}
    SELECT 'c' || c AS domain, CASE WHEN k % 3 = 1 THEN 'Detail ' || p ELSE 'Post ' || k END AS title, 'https://c' || c || '.example.com/jobs/' || (k + 1000000) || CASE WHEN k % 3 = 1 THEN '#job-' || {D.slug("'Detail ' || p")} ELSE '' END AS url,
           CASE WHEN k % 3 = 1 THEN 'json-ld' ELSE 'html-heuristic' END AS source FROM shown
    UNION ALL SELECT 'c' || c, 'On page ' || page, 'https://c' || c || '.example.com/own/' || page, 'json-ld' FROM reached WHERE c % 4 = 0""")
def generic_reading(t):
    """RD-8 / RD-9 / HTML-7: from landed pages through further result pages and posting pages to postings."""
    landed, listings = _read_sites(t)
    return landed.read(listings).select("domain", "title", "url", "source")


@query("listing_rounds", f"WITH {_SITES} SELECT 'c' || c AS domain, count(*)::BIGINT AS pages, max(page)::BIGINT - 1 AS rounds FROM reached GROUP BY c")
def listing_rounds(t):
    """HTML-7: result pages found by following one another, and in how many rounds."""
    _, listings = _read_sites(t)
    return listings.groupBy("domain").agg(F.count("*").alias("pages"), F.max("round").cast("bigint").alias("rounds"))


@query("listings_too_long", f"""
    WITH {_SITES} SELECT 'c' || c AS domain, max(page)::BIGINT + 1 AS last_page FROM reached WHERE links >= 3 AND page <= 2 GROUP BY c HAVING max(page) + 1 > 2""")
def listings_too_long(t):
    """SRC-5: companies whose listing has more pages than the crawl would fetch."""
    landed, listings = _read_sites(t, upto=2)
    return landed.too_long(listings)
