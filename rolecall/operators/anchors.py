"""Links on crawled pages. Every function takes pages with `html` and `final_url` and never carries `html` on."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX, urls as U, vocab as V
from .keyed import computed, first_per_key, top_per_key

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
OPENING = r"""<a\s(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""     # a quoted value may hold '>'
ANCHOR = rf"(?is){OPENING}.*?</a\s*>"
INNER = rf"(?is)^{OPENING}(.*)</a\s*>$"
HREF = r"""(?is)[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
BARE_HREF = r"""(?i)href\s*=\s*["']([^"'#>\s]+)"""


def anchors(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per link: the kept columns, pos, href, url (absolute, no fragment) and chunks (its texts in order).

    Comments, scripts and styles hold no links and no link text.
    """
    seen = F.regexp_replace("html", UNSEEN, " ")
    tags = pages.select(*keep, "final_url", F.posexplode(F.regexp_extract_all(seen, F.lit(ANCHOR), F.lit(0)))
                        .alias("pos", "tag"))
    tags, opening = computed(tags, __opening=F.regexp_extract("tag", f"(?is)^{OPENING}", 0)), F.col("__opening")
    raw = F.concat(*[F.regexp_extract(opening, HREF, g) for g in (1, 2, 3)])
    inner = F.regexp_extract("tag", INNER, 1)
    chunks = F.filter(F.transform(F.split(inner, r"<[^>]*>"), lambda x: TX.clean(TX.unescape_markup(x))),
                      lambda x: x.isNotNull())
    links = computed(tags.filter(opening.rlike(HREF)), href=TX.unescape_markup(raw), chunks=chunks).drop("tag", "__opening")
    return computed(links, url=U.without_fragment(U.resolve(F.col("final_url"), F.col("href"))))


def is_job_link(url: Column, domains: Column, listing_url: Column) -> Column:
    """Does a URL look like one posting on the company's own site (and not like the listing it was found on)?"""
    step = F.lit(V.JOB_STEP + r"(?=/*([^/?#]*))")
    path = U.path(url)
    segments = F.regexp_extract_all(path, step, F.lit(1))
    following = F.regexp_extract_all(path, step, F.lit(2))

    def posting(pair: Column) -> Column:
        segment = F.lower(pair["segment"])
        listing = segment.isin(V.LISTING_SEGMENTS)
        return (listing & pair["following"].rlike(r"\d")) | (
            ~listing & ~segment.isin(V.NAV_SEGMENTS) & ~segment.rlike(V.NAV_PREFIX))

    pairs = F.arrays_zip(segments.alias("segment"), following.alias("following"))
    eligible = (U.scheme(url).isin("http", "https") & U.on_site(U.host(url), domains)
                & (U.url_key(url) != U.url_key(listing_url)) & ~url.rlike(r"[?&]page="))
    return eligible & (F.exists(pairs, posting) | F.concat(F.lit("?"), U.query(url)).rlike(V.JOB_QUERY))


def count_job_links(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Distinct posting-looking links per page, from the bare href attributes (no tag parsing)."""
    hrefs = pages.select(*keep, "final_url", "domains", F.explode_outer(
        F.regexp_extract_all("html", F.lit(BARE_HREF), F.lit(1))).alias("href"))
    urls = computed(hrefs, url=U.resolve(F.col("final_url"), F.replace("href", F.lit("&amp;"), F.lit("&"))))
    hits = urls.select(*keep, F.when(is_job_link(F.col("url"), F.col("domains"), F.col("final_url")),
                                     U.url_key(F.col("url"))).alias("key"))
    return hits.groupBy(*keep).agg(F.count_distinct("key").alias("job_links"))


def job_links(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Posting-looking links of each page, first per URL key: keep columns, pos, url, url_key, title, location."""
    return job_links_among(anchors(pages, [*keep, "domains"]), keep)


def job_links_among(links: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`job_links` of pages whose `anchors` are there already (with `domains` kept)."""
    links = links.filter(is_job_link(F.col("url"), F.col("domains"), F.col("final_url")))
    first = F.get("chunks", F.lit(0))
    poor = first.isNull() | F.lower(first).isin(V.GENERIC_LINK_TEXT) | ~F.length(first).between(3, 150)
    title = F.when(poor, TX.title_from_path(U.path(F.col("url")))).otherwise(first)
    place = F.get(F.filter(F.slice("chunks", 2, F.greatest(F.size("chunks"), F.lit(1))),
                           lambda c: c.rlike(V.LOCATION_TEXT)), F.lit(0))
    named = computed(links, title=title, location=place, url_key=U.url_key(F.col("url"))).filter(
        F.col("title").isNotNull() & ~F.col("title").rlike(V.UTILITY_TITLE) & ~F.col("title").rlike(V.NAV_TITLE))
    return (first_per_key(named, [*keep, "url_key"], [F.col("pos")])
            .select(*keep, "pos", "url", "url_key", "title", "location"))


def view_all_links(pages: DataFrame, site: str, page_order: str, top: int) -> DataFrame:
    """'View all jobs' style links of a site's pages, in order, without repeats: the first `top` of each site."""
    links = anchors(pages, [site, page_order])
    links = computed(links, text=F.coalesce(TX.clean(F.array_join("chunks", " ")), F.lit("")))
    url, text = F.col("url"), F.col("text")
    hits = links.filter(
        url.rlike("^https?://") & (U.url_key(url) != U.url_key(F.col("final_url"))) & (F.length(text) <= 60)
        & (text.rlike(V.VIEW_ALL) | (text.rlike(V.BARE_JOBS_TEXT) & U.path(url).rlike(V.JOBS_PATH))))
    order = [F.col(page_order), F.col("pos")]
    once = first_per_key(hits.select(site, page_order, "pos", "url"), [site, "url"], order)
    return top_per_key(once, [site], order, top, rank="rank").select(site, "rank", "url")


def pagination(pages: DataFrame, keep: Sequence[str], upto: int) -> DataFrame:
    """Other result pages of a paginated listing: keep columns, page_number, url and last_page (how many there are).

    `upto` is the last page the caller would fetch; a larger last_page tells that the listing is longer.
    """
    return pagination_among(anchors(pages, keep), keep, upto)


def pagination_among(links: DataFrame, keep: Sequence[str], upto: int) -> DataFrame:
    """`pagination` of pages whose `anchors` are there already."""
    full = U.resolve(F.col("final_url"), F.col("href"))
    same = (U.host(F.col("full")) == U.host(F.col("final_url"))) & (
        F.rtrim(U.path(F.col("full")), F.lit("/")) == F.rtrim(U.path(F.col("final_url")), F.lit("/")))
    params = (computed(links, full=full).filter(same)
              .select(*keep, "pos", "full", F.posexplode(F.split(U.query(F.col("full")), "&")).alias("at", "pair"))
              .withColumn("name", F.substring_index("pair", "=", 1))
              .withColumn("number", F.regexp_extract("pair", r"=(\d+)$", 1).try_cast("bigint"))
              .filter(F.col("name").rlike(V.PAGE_PARAMETER) & (F.col("number") > 1)))
    last = params.groupBy(*keep).agg(F.max_by(
        F.struct("name", "full", "number"), F.struct("number", -F.col("pos"), -F.col("at"))).alias("m"))
    numbered = last.select(*keep, "m.*").withColumn(
        "page_number", F.explode(F.sequence(F.lit(2), F.least("number", F.lit(upto)).cast("int"))))
    pairs = F.filter(F.split(U.query(F.col("full")), "&"), lambda p: p.rlike("^[^=]*=."))
    query = F.array_join(F.transform(pairs, lambda p: F.when(
        F.substring_index(p, "=", 1) == F.col("name"),
        F.concat(F.col("name"), F.lit("="), F.col("page_number").cast("string"))).otherwise(p)), "&")
    return numbered.select(
        *keep, "page_number", F.concat(F.regexp_extract("full", r"^([^?#]*)", 1), F.lit("?"), query).alias("url"),
        F.col("number").alias("last_page"))
