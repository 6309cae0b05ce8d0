"""Queries over crawled pages: link tables, page labels, careers-page discovery."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C, text as TX, urls as U, vocab as V
from ..operators import anchors as A, discovery as DS
from ..operators.keyed import computed, first_per_key
from . import duck as D
from .registry import pick, query, utc

col, lit = F.col, F.lit

# The pages table holds root-relative links only; these endings add the kinds of links a careers site has.
ENDINGS = [
    "",
    '<a href="/careers/software-engineer-123456">Software Engineer <span>Remote, US</span></a>'
    '<a class="x" href="/careers/search">Search jobs</a><a href="/jobs/list/135592/">View job</a>'
    '<a href="/jobs/list/?location=x">All</a><a href="/careers/software-engineer-123456#apply">Apply now</a>',
    "<a href='/careers/search/job/data-analyst-225712?ref=1'>Apply</a><a href=\"/jobs/teams\">Teams</a>"
    '<a href="/about">Our careers</a><a href="/positions/work-with-us-1">Work with us</a>',
    '<a href="/careers">Careers</a><a href="/jobs">Jobs</a><a href="/open-roles?x=1&amp;y=2">See all open roles</a>'
    '<a href="https://www.linkedin.com/company/acme/jobs/">Jobs</a>',
    '<a href="/x?gh_jid=42&amp;s=1">Field Engineer<br>Berlin, Germany</a><a href="/jobs/my-jobs">My jobs</a>'
    '<a href="https://careers.elsewhere.com/jobs">Careers</a><a href="mailto:jobs@x.com">Jobs</a>'
    "<a href=/roles/night-watch-77>Learn more</a>",
    '<a href="/jobs/">View all jobs</a><a href="/team">open positions</a><a href="/job-search/">Job search</a>'
    '<a href="/en/careers/?p=1">we\'re hiring</a><a href="https://twitter.com/jobs">Careers</a>',
    '<script>var u="https:\\/\\/boards.greenhouse.io\\/acme\\/jobs\\/1?gh_jid=11";</script>'
    '<a href="https://jobs.lever.co/acme">Open roles</a><a href="https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/1">Jobs</a>',
    '<div id="root"></div>',
]
STATUSES = [200, 200, 200, 200, 404, 200, 403, 200, 503]

CRAWL = f"""crawl AS (SELECT page_id, url AS final_url, {D.host('url')} AS site, [{D.site_domain('url')}] AS domains,
    {D.pick(STATUSES, 'page_id')} AS status, html || {D.pick(ENDINGS, 'page_id')} AS html FROM pages)"""


def crawl(t):
    url = col("url")
    return t.pages.select("page_id", url.alias("final_url"), U.host(url).alias("site"),
                          F.array(U.registrable_domain(U.host(url))).alias("domains"),
                          pick(STATUSES, col("page_id")).alias("status"),
                          F.concat("html", pick(ENDINGS, col("page_id"))).alias("html"))


@query("crawl_pages", f"""
    WITH {CRAWL} SELECT url, count(*)::BIGINT AS copies, min(page_id) AS first_page FROM pages GROUP BY url""")
def crawl_pages(t):
    """SRC-1: the crawl table, one row per distinct fetched address."""
    return t.pages.groupBy("url").agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page"))


@query("page_links", f"""
    WITH {CRAWL}, links AS ({D.anchors('crawl', 'page_id')})
    SELECT page_id, pos, href, url, array_to_string(chunks, ' | ') AS text FROM links""")
def page_links(t):
    """HTML-1 / URL-5: every link of every page, resolved."""
    return A.anchors(crawl(t), ["page_id"]).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "url",
                                                   F.array_join("chunks", " | ").alias("text"))


@query("site_link_counts", f"""
    WITH {CRAWL}, links AS ({D.anchors('crawl', 'page_id')}),
    firsts AS (SELECT DISTINCT ON (k) * FROM (SELECT *, {D.url_key('url')} AS k FROM links) ORDER BY k, page_id, pos)
    SELECT {D.site_domain('url')} AS domain, count(*)::BIGINT AS links, count(DISTINCT {D.host('url')})::BIGINT AS hosts,
           min(page_id) AS first_page FROM firsts GROUP BY 1""")
def site_link_counts(t):
    """Flagship: link table -> resolved -> first per URL key -> counts per company domain."""
    links = A.anchors(crawl(t), ["page_id"]).select("page_id", "pos", "url", U.url_key(col("url")).alias("key"))
    firsts = first_per_key(links, ["key"], [col("page_id"), col("pos")])
    return (firsts.groupBy(U.registrable_domain(U.host(col("url"))).alias("domain"))
            .agg(F.count("*").alias("links"), F.count_distinct(U.host(col("url"))).alias("hosts"),
                 F.min("page_id").alias("first_page")).orderBy(F.desc("links"), "domain"))


@query("on_site_links", f"""
    WITH {CRAWL}, links AS ({D.anchors('crawl', 'page_id, domains')})
    SELECT page_id, count(*) FILTER (WHERE o)::BIGINT AS own, count(*) FILTER (WHERE NOT o)::BIGINT AS elsewhere
    FROM (SELECT page_id, len(list_filter(domains, lambda d: {D.same_site(D.host('url'), 'd')})) > 0 AS o FROM links)
    GROUP BY page_id""")
def on_site_links(t):
    """URL-4: links that stay on the company's own domains."""
    own = U.on_site(U.host(col("url")), col("domains"))
    return (A.anchors(crawl(t), ["page_id", "domains"]).groupBy("page_id")
            .agg(F.count_if(own).alias("own"), F.count_if(~own).alias("elsewhere")))


@query("page_titles", f"SELECT page_id, {D.page_title('html')} AS title FROM pages")
def page_titles(t):
    """HTML-2."""
    return t.pages.select("page_id", C.page_title(col("html")).alias("title"))


@query("visible_text_length", f"""
    WITH {CRAWL} SELECT page_id, length({D.visible_text('html')})::BIGINT AS characters FROM crawl""")
def visible_text_length(t):
    """HTML-3."""
    return crawl(t).select("page_id", F.length(C.visible_text(col("html"))).cast("bigint").alias("characters"))


_BARE = D.lit(A.BARE_HREF)


@query("job_link_counts", f"""
    WITH {CRAWL}, hrefs AS (SELECT page_id, final_url, domains, unnest(regexp_extract_all(html, {_BARE}, 1)) AS href FROM crawl),
    urls AS (SELECT page_id, final_url, domains, {D.resolve('final_url', "replace(href, '&amp;', '&')")} AS url FROM hrefs)
    SELECT c.page_id, count(DISTINCT CASE WHEN u.url IS NOT NULL THEN {D.url_key('u.url')} END)::BIGINT AS job_links FROM crawl c LEFT JOIN urls u
    ON u.page_id = c.page_id AND {D.is_job_link('u.url', 'u.domains', 'u.final_url')} GROUP BY c.page_id""")
def job_link_counts(t):
    """HTML-4 / CLS-9 / AGG-12: distinct posting-looking links per page."""
    return A.count_job_links(crawl(t), ["page_id"])


def _title_from_path_sql(u):
    p = f"string_split(rtrim({D.path(u)}, '/'), '/')[-1]"
    w = f"trim(regexp_replace(regexp_replace({p}, '[-_]?\\d{{4,}}$', ''), '[-_]+', ' ', 'g'))"
    return f"CASE WHEN length({w}) >= 3 THEN {D.title_case(w)} END"


_JOB_LINKS = f"""links AS ({D.anchors('crawl', 'page_id, site, domains')}),
    hits AS (SELECT * FROM links WHERE {D.is_job_link('url', 'domains', 'final_url')}),
    named AS (SELECT *, {D.url_key('url')} AS url_key,
        CASE WHEN chunks[1] IS NULL OR lower(chunks[1]) IN {D.in_list(V.GENERIC_LINK_TEXT)}
             OR length(chunks[1]) NOT BETWEEN 3 AND 150 THEN {_title_from_path_sql('url')} ELSE chunks[1] END AS title,
        list_filter(chunks[2:], lambda c: regexp_matches(c, {D.re2(V.LOCATION_TEXT)}))[1] AS location FROM hits),
    job_links AS (SELECT DISTINCT ON (page_id, url_key) page_id, site, pos, url, url_key, title, location FROM named
        WHERE title IS NOT NULL AND NOT regexp_matches(title, {D.re2(V.UTILITY_TITLE)})
              AND NOT regexp_matches(title, {D.re2(V.NAV_TITLE)}) ORDER BY page_id, url_key, pos)"""


@query("page_job_links", f"WITH {CRAWL}, {_JOB_LINKS} SELECT page_id, url, url_key, title, location FROM job_links")
def page_job_links(t):
    """HTML-5 / CLS-9 / CLS-10 / CLS-11 / WIN-3: posting links with titles and locations."""
    return A.job_links(crawl(t), ["page_id"]).select("page_id", "url", "url_key", "title", "location")


@query("view_all_links", f"""
    WITH {CRAWL}, links AS ({D.anchors('crawl', 'site, page_id')}),
    hits AS (SELECT site, page_id, pos, url, coalesce({D.clean("array_to_string(chunks, ' ')")}, '') AS text, final_url FROM links),
    good AS (SELECT * FROM hits WHERE regexp_matches(url, '^https?://') AND {D.url_key('url')} <> {D.url_key('final_url')}
        AND length(text) <= 60 AND (regexp_matches(text, {D.re2(V.VIEW_ALL)})
        OR (regexp_matches(text, {D.re2(V.BARE_JOBS_TEXT)}) AND regexp_matches({D.path('url')}, {D.re2(V.JOBS_PATH)})))),
    once AS (SELECT DISTINCT ON (site, url) site, page_id, pos, url FROM good ORDER BY site, url, page_id, pos)
    SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS rank, url FROM once
    QUALIFY rank <= 5""")
def view_all_links(t):
    """HTML-6: one hop to the full listing."""
    return A.view_all_links(crawl(t), "site", "page_id", top=5).withColumn("rank", col("rank").cast("bigint"))


_PAGED = (f"paged AS (SELECT page_id, {D.without_fragment('url')} AS final_url, html || '<a href=\"' || {D.path('url')} || "
          "'?ref=a&amp;page=' || (page_id % 60)::VARCHAR || '&amp;x=\">' || page_id || '</a><a href=\"?Page=3\">3</a>' AS html FROM pages)")


@query("pagination", f"""
    WITH {_PAGED}, links AS ({D.anchors('paged', 'page_id')}),
    fulls AS (SELECT page_id, pos, final_url, {D.resolve('final_url', 'href')} AS f FROM links),
    params AS (SELECT page_id, pos, f, unnest(string_split({D.url_query('f')}, '&')) AS pair,
                      unnest(range(len(string_split({D.url_query('f')}, '&')))) AS nth FROM fulls
               WHERE {D.host('f')} = {D.host('final_url')} AND rtrim({D.path('f')}, '/') = rtrim({D.path('final_url')}, '/')),
    best AS (SELECT DISTINCT ON (page_id) page_id, f, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2)::BIGINT AS n
             FROM params WHERE regexp_matches(pair, '(?i)^(page|p|pg|pagenum|page_num|pagenumber)=[0-9]+$')
             AND split_part(pair, '=', 2)::BIGINT > 1 ORDER BY page_id, n DESC, pos, nth)
    SELECT page_id, k::BIGINT AS page_number, n AS last_page,
           regexp_extract(f, '^([^?#]*)', 1) || '?' || array_to_string(list_transform(list_filter(
             string_split({D.url_query('f')}, '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
             lambda p: CASE WHEN split_part(p, '=', 1) = name THEN name || '=' || k ELSE p END), '&') AS url
    FROM (SELECT *, unnest(range(2, least(n, 10000) + 1)) AS k FROM best)""")
def pagination(t):
    """HTML-7 / AGG-13: the other result pages of a listing, and how many it has."""
    url = U.without_fragment(col("url"))
    more = F.concat(lit('<a href="'), U.path(url), lit("?ref=a&amp;page="), (col("page_id") % 60).cast("string"),
                    lit('&amp;x=">'), col("page_id").cast("string"), lit('</a><a href="?Page=3">3</a>'))
    paged = t.pages.select("page_id", url.alias("final_url"), F.concat("html", more).alias("html"))
    return A.pagination(paged, ["page_id"], upto=10_000).withColumn("page_number", col("page_number").cast("bigint"))


# ---- page labels ----

CHALLENGES = ["<title>Just a  moment...</title>", "<p>Please solve the captcha</p>", "", "<title> Access Denied</title>",
              "Reference #18.2f3a", "<title>Careers</title><p>enable JavaScript and cookies</p>"]
_SHORT = f"CASE WHEN page_id % 2 = 0 THEN {D.pick(CHALLENGES, 'page_id // 2')} || html ELSE html END"


def _maybe_challenge():
    return F.when(col("page_id") % 2 == 0, F.concat(pick(CHALLENGES, F.floor(col("page_id") / 2)), "html")) \
        .otherwise(col("html"))


@query("challenge_pages", f"""
    SELECT page_id, status, {D.is_challenge('h')} AS challenge, status IN (403, 429, 503) OR {D.is_challenge('h')} AS blocked,
           status = 200 AND h <> '' AND NOT {D.is_challenge('h')} AS ok
    FROM (SELECT page_id, {D.pick(STATUSES, 'page_id')} AS status, {_SHORT} AS h FROM pages)""")
def challenge_pages(t):
    """CLS-6 / CLS-7: bot-protection pages, blocked and usable pages."""
    p = t.pages.select("page_id", pick(STATUSES, col("page_id")).alias("status"), _maybe_challenge().alias("html"))
    p = p.select("page_id", "status", (col("html") != "").alias("filled"), C.is_challenge(col("html")).alias("challenge"))
    return p.select("page_id", "status", "challenge", C.is_blocked(col("status"), col("challenge")).alias("blocked"),
                    C.page_ok(col("status"), F.when(col("filled"), lit("x")).otherwise(""), col("challenge")).alias("ok"))


@query("pages_to_render", f"""
    WITH {CRAWL}, f AS (SELECT page_id, status, len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=')) < 5 AS few,
        length({D.visible_text('html')}) < 2000 OR regexp_matches(html, {D.lit(V.SPA_SHELL)}) AS thin,
        status = 200 AND html <> '' AND NOT {D.is_challenge('html')} AS ok FROM crawl)
    SELECT page_id, status IN (403, 429, 503) OR (ok AND few) AS render,
           status IN (403, 429, 503) OR (ok AND (few OR thin)) AS render_thorough FROM f""")
def pages_to_render(t):
    """CLS-8: pages better read in a browser."""
    html, status = col("html"), col("status")
    ch = C.is_challenge(html)
    return crawl(t).select("page_id", C.needs_rendering(status, html, ch).alias("render"),
                           C.needs_rendering(status, html, ch, thorough=True).alias("render_thorough"))


@query("page_reuse", f"""
    SELECT user_id, event_type, max_by(event_id, ts) AS event_id, max(ts) AS fetched_at FROM events
    WHERE ts >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '2024-01-30 23:00:00'
      AND event_type <> 'error' AND value <= 50 GROUP BY user_id, event_type""")
def page_reuse(t):
    """SRC-3: the newest stored fetch per address, if it is young enough and may be reused at all."""
    from ..sources.crawl import reusable
    status = F.when(col("event_type") == "error", 500).when(col("value") > 50, 429).otherwise(200)
    log = t.events.select("event_id", "user_id", "event_type", col("ts").alias("fetched_at"), status.alias("status"),
                          lit("<p>x</p>").alias("html"), lit(None).cast("string").alias("error"))
    return reusable(log, ["user_id", "event_type"], F.expr("TIMESTAMP_NTZ '2024-01-30 23:00:00'"), "12h") \
        .select("user_id", "event_type", "event_id", "fetched_at")


@query("address_list", f"""
    WITH typed AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ' || {D.host('url')} ELSE 'nowhere' END AS raw FROM pages),
    once AS (SELECT trim(raw) AS raw, min(page_id) AS pos FROM typed WHERE trim(raw) <> '' GROUP BY 1),
    parsed AS (SELECT raw, pos, CASE WHEN contains(raw, '.') THEN {D.site_domain("CASE WHEN contains(raw, '://') THEN raw ELSE 'https://' || raw END")} END AS domain FROM once)
    SELECT raw, domain, CASE WHEN domain IS NULL THEN 'invalid' WHEN domain IN (SELECT {D.site_domain('url')} FROM pages
           WHERE contains(url, 'spam')) THEN 'ignored' ELSE 'added' END AS status FROM parsed""")
def address_list(t):
    """SRC-7: typed addresses -> added, ignored (being scanned already) or invalid."""
    from ..sources.crawl import accept_addresses
    k = col("page_id") % 3
    raw = (F.when(k == 0, col("url")).when(k == 1, F.concat(lit(" "), U.host(col("url")))).otherwise(lit("nowhere")))
    typed = t.pages.select(raw.alias("raw"))
    active = (t.pages.filter(F.contains("url", lit("spam")))
              .select(U.registrable_domain(U.host(col("url"))).alias("domain")).distinct())
    return accept_addresses(typed, active).select("raw", "domain", "status")


@query("sitemap_candidates", f"""
    SELECT site, url, rank FROM (SELECT site, u AS url, row_number() OVER (PARTITION BY site
        ORDER BY len(string_split({D.path('u')}, '/')), length(u), u) AS rank
      FROM (SELECT DISTINCT {D.host('url')} AS site, regexp_replace(url, '/(en|fr)/', '/\\1/jobs/') AS u FROM pages)
      WHERE list_has_any(string_split({D.path('u')}, '/'), ['careers', 'career', 'jobs', 'job'])) WHERE rank <= 5""")
def sitemap_candidates(t):
    """SRC-8: listing addresses from a sitemap, shortest first, five per site."""
    from ..sources.crawl import sitemap_candidates as best
    urls = t.pages.select(U.host(col("url")).alias("site"), F.regexp_replace("url", "/(en|fr)/", "/$1/jobs/").alias("url"))
    return best(urls, "site", top=5).withColumn("rank", col("rank").cast("bigint"))


# ---- discovery ----

def _score_sql():
    t = D.collapse("array_to_string(chunks, ' ')")
    asked = f"lower({D.path('url')} || CASE WHEN {D.url_query('url')} <> '' THEN '?' || {D.url_query('url')} ELSE '' END)"
    return (f"(CASE WHEN regexp_matches({asked}, {D.re2(V.CAREERS_HREF)}) THEN 10 ELSE 0 END + CASE WHEN lower({t}) IN "
            f"{D.in_list(V.CAREERS_TEXT_EXACT)} THEN 20 WHEN regexp_matches({t}, {D.re2(V.CAREERS_TEXT)}) THEN 10 ELSE 0 END)")


_SCORED = f"""home AS (SELECT DISTINCT ON (site) * FROM crawl ORDER BY site, page_id DESC),
    links AS ({D.anchors('home', 'site, domains')}),
    scored AS (SELECT site, pos, url, {_score_sql()} AS score,
        len(list_filter(domains, lambda d: {D.same_site(D.host('url'), 'd')})) > 0 AS own,
        {D.site_domain('url')} AS target FROM links WHERE {D.scheme('url')} IN ('http', 'https'))"""
_DENY = D.in_list([*V.JOB_BOARDS, *V.SOCIAL_SITES])


def homes(t):
    return first_per_key(crawl(t), ["site"], [col("page_id").desc()])


@query("homepage_links", f"""
    WITH {CRAWL}, {_SCORED}, best AS (SELECT site, url, max(score) AS score, min(pos) AS pos FROM scored
      WHERE score > 0 AND (own OR (score >= 20 AND target NOT IN {_DENY})) GROUP BY site, url)
    SELECT site, url, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, pos) AS rank FROM best QUALIFY rank <= 10""")
def homepage_links(t):
    """HTML-8 / WIN-7: careers links of home pages, best ten."""
    return DS.homepage_links(homes(t), top=10).withColumn("rank", col("rank").cast("bigint"))


@query("homepage_job_boards", f"""
    WITH {CRAWL}, {_SCORED} SELECT DISTINCT site, CASE target {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.JOB_BOARDS.items())} END
    AS job_board FROM scored WHERE NOT own AND score >= 20 AND target IN {D.in_list(V.JOB_BOARDS)}""")
def homepage_job_boards(t):
    """HTML-8: companies whose careers link leads to a job board."""
    return DS.homepage_job_boards(homes(t))


_TYPED = D.pick(["/about/jobs", "/"], "length(site)")


@query("careers_probes", f"""
    WITH {CRAWL}, {_SCORED}, sites AS (SELECT site, 'https://' || site || '/' AS root_url, domains[1] AS domain,
        'https://' || site || {_TYPED} AS input_url FROM home),
    p AS (SELECT site, input_url AS url, 80 AS score FROM sites WHERE trim({D.path('input_url')}, '/') <> ''
      UNION ALL SELECT site, 'https://' || site || '/' || unnest({V.PROBE_PATHS}) AS url, 15 FROM sites
      UNION ALL SELECT site, 'https://' || unnest(['careers', 'jobs']) || '.' || domain || '/', 0 FROM sites
      UNION ALL SELECT site, url, score FROM scored WHERE score > 0 AND own)
    SELECT site, url, max(score) AS score FROM p GROUP BY site, url""")
def careers_probes(t):
    """HTML-9: addresses to look at per site, each with its best score."""
    site = homes(t)
    sites = site.select("site", F.concat(lit("https://"), "site", lit("/")).alias("root_url"), col("domains")[0].alias("domain"),
                        F.concat(lit("https://"), "site", pick(["/about/jobs", "/"], F.length("site"))).alias("input_url"))
    links = DS._scored(site, "site").filter((col("score") > 0) & col("own"))
    return DS.probes(sites, links).select("site", "url", "score")


_LANDING = ["/careers", "/jobs/", "/en/careers", "/fr/jobs", "/about/team/careers", "/x"]
_LAND_URL = f"regexp_extract(url, '^([^/]*//[^/]*)', 1) || {D.pick(_LANDING, 'page_id')}"


def _final_score_sql(u, base):
    return (f"({base} + CASE WHEN regexp_matches({D.host(u)}, {D.re2(V.ATS_HOST)}) THEN 60 ELSE 0 END "
            f"+ CASE WHEN regexp_matches({D.path(u)}, {D.re2(V.EXACT_CAREERS_PATH)}) THEN 50 ELSE 0 END "
            f"+ CASE WHEN {D.host(u)} LIKE 'careers.%' OR {D.host(u)} LIKE 'jobs.%' THEN 45 ELSE 0 END "
            f"- CASE WHEN {D.non_english_locale(D.path(u))} THEN 40 ELSE 0 END "
            f"- 3 * len(list_filter(string_split({D.path(u)}, '/'), lambda s: s <> '')))")


@query("candidate_scores", f"""
    SELECT page_id, u AS final_url, {_final_score_sql('u', 'page_id % 90')}::BIGINT AS score
    FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace({_LAND_URL}, '//', '//careers.') ELSE {_LAND_URL} END AS u FROM pages)""")
def candidate_scores(t):
    """HTML-10: what the address itself says about a candidate."""
    u = F.concat(F.regexp_extract("url", "^([^/]*//[^/]*)", 1), pick(_LANDING, col("page_id")))
    u = F.when(col("page_id") % 4 == 0, F.replace(u, lit("//"), lit("//careers."))).otherwise(u)
    return t.pages.select("page_id", u.alias("final_url")).select(
        "page_id", "final_url", DS.final_score(col("final_url"), col("page_id") % 90).cast("bigint").alias("score"))


@query("soft_404", f"""
    WITH f AS (SELECT page_id, {D.host('url')} AS site, url, {D.page_title('html')} AS title, length(html) AS size FROM pages),
    home AS (SELECT DISTINCT ON (site) * FROM f ORDER BY site, page_id)
    SELECT f.page_id, coalesce({D.url_key('f.url')} = {D.url_key('h.url')} OR (f.title <> '' AND f.title = h.title
           AND abs(f.size - h.size) <= 0.03 * greatest(h.size, 1)), false) AS is_home,
           regexp_matches(f.title, {D.re2(V.CAREERS_TITLE)}) OR regexp_matches({D.path('f.url')}, {D.re2(V.CAREERS_PATH)}) AS careers,
           regexp_matches(f.title, {D.re2(V.NOT_FOUND_TITLE)}) AS not_found FROM f JOIN home h ON h.site = f.site""")
def soft_404(t):
    """CLS-15 / CLS-16: pages that are the home page again, careers-looking and not-found pages."""
    html = col("html")
    f = computed(t.pages, site=U.host(col("url")), title=C.page_title(html), size=F.length(html)).drop("html")
    home = first_per_key(f, ["site"], [col("page_id")]).select(
        "site", col("url").alias("home_url"), col("title").alias("home_title"), col("size").alias("home_size"))
    return f.join(home, "site").select(
        "page_id", DS.looks_like_home(col("url"), col("title"), col("size"), col("home_url"), col("home_title"), col("home_size"))
        .alias("is_home"), C.careers_looking(col("title"), U.path(col("url"))).alias("careers"),
        C.not_found_title(col("title")).alias("not_found"))


_CAND = f"""f AS (SELECT page_id AS pos, {D.site_domain('url')} AS site, [{D.site_domain('url')}] AS domains,
      CASE WHEN page_id % 9 = 4 THEN 'https://jobs.elsewhere.com/careers' ELSE {_LAND_URL} END AS u,
      {D.pick(STATUSES, 'page_id')} AS status, {D.page_title('html')} AS title, {D.is_challenge('html')} AS challenge, html <> '' AS filled, length(html) AS size,
      {D.pick([80, 20, 15, 10, 0], 'page_id')} AS base, page_id % 5 = 0 OR page_id % 9 = 4 AS asked FROM pages),
    home AS (SELECT site, u AS home_url, title AS home_title, size AS home_size FROM f WHERE status = 200 AND filled AND NOT challenge
      QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos DESC) = 1),
    g AS (SELECT f.*, (status IN (403, 429, 503) OR challenge) AND (asked OR regexp_matches({D.path('u')}, {D.re2(V.CAREERS_PATH)})) AS blocked,
      status = 200 AND filled AND NOT challenge AND NOT regexp_matches(title, {D.re2(V.NOT_FOUND_TITLE)})
        AND NOT coalesce({D.url_key('u')} = {D.url_key('home_url')} OR (title <> '' AND title = home_title AND abs(size - home_size) <= 0.03 * greatest(home_size, 1)), false) AS fine,
      regexp_matches(title, {D.re2(V.CAREERS_TITLE)}) OR regexp_matches({D.path('u')}, {D.re2(V.CAREERS_PATH)}) AS careers,
      NOT (len(list_filter(domains, lambda d: {D.same_site(D.host('u'), 'd')})) > 0) AS elsewhere FROM f LEFT JOIN home USING (site)),
    kept AS (SELECT *, {_final_score_sql('u', 'base')} AS s, {D.url_key('u')} AS url_key FROM g WHERE (blocked OR fine)
      AND (NOT elsewhere OR CASE WHEN blocked THEN asked ELSE careers END) AND (careers OR blocked)),
    merged AS (SELECT site, url_key, list_reduce(list(s ORDER BY pos), lambda acc, x: greatest(acc, x) + 5) AS score,
      count(*) AS hits, min(pos) AS pos, arg_min(u, pos) AS final_url,
      arg_min(CASE WHEN elsewhere THEN {D.host('u')} ELSE '' END, pos) AS hosted FROM kept GROUP BY site, url_key)"""


def _candidates(t):
    html, pos = col("html"), col("page_id")
    url = F.when(pos % 9 == 4, lit("https://jobs.elsewhere.com/careers")).otherwise(
        F.concat(F.regexp_extract("url", "^([^/]*//[^/]*)", 1), pick(_LANDING, pos)))
    site = U.registrable_domain(U.host(col("url")))
    pages = t.pages.select(pos.alias("pos"), site.alias("site"), F.array(site).alias("domains"), url.alias("final_url"),
                           pick(STATUSES, pos).alias("status"), pick([80, 20, 15, 10, 0], pos).alias("base_score"),
                           ((pos % 5 == 0) | (pos % 9 == 4)).alias("asked_for"), "html")
    features = DS.page_features(pages, ["pos", "site", "domains", "base_score", "asked_for"])
    home = first_per_key(features.filter("ok"), ["site"], [col("pos").desc()])
    home = home.select("site", col("final_url").alias("home_url"), col("title").alias("home_title"), col("size").alias("home_size"))
    return DS.merged_candidates(features, home)


@query("careers_candidates", f"""
    WITH {_CAND} SELECT site, url_key, final_url, score::BIGINT AS score, hits::BIGINT AS hits,
      row_number() OVER (PARTITION BY site ORDER BY score DESC, pos) AS rank FROM merged QUALIFY rank <= 3""")
def careers_candidates(t):
    """HTML-11: merged and scored candidates, best three per company."""
    return DS.best_candidates(_candidates(t), top=3).select("site", "url_key", "final_url", col("score").cast("bigint").alias("score"), "hits",
                                 col("rank").cast("bigint").alias("rank"))


@query("careers_domains", f"""
    WITH {_CAND} SELECT site, site AS careers_domain FROM merged UNION SELECT site, {D.registrable_domain('hosted')} FROM merged WHERE hosted <> ''""")
def careers_domains(t):
    """HTML-12: domains that count as a company's own."""
    return DS.careers_domains(_candidates(t).withColumn("domain", col("site")))
