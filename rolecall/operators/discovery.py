"""Finding a company's careers page among its pages: link scores, probes, candidate scores and merging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, text as TX, urls as U, vocab as V
from .anchors import anchors
from .keyed import computed, ordinal, top_per_key


def link_score(path_and_query: Column, text: Column) -> Column:
    words = (F.when(F.lower(text).isin(V.CAREERS_TEXT_EXACT), 20).when(text.rlike(V.CAREERS_TEXT), 10).otherwise(0))
    return F.when(F.lower(path_and_query).rlike(V.CAREERS_HREF), 10).otherwise(0) + words


def homepage_links(homes: DataFrame, top: int, site: str = "site") -> DataFrame:
    """The `top` careers-looking links of each home page, best first: site, rank, url, score.

    A link to another domain must clearly say careers; job boards and social sites never count (their names come
    back in `job_board` rows of `homepage_job_boards`).
    """
    hits = _scored(homes, site).filter((F.col("score") > 0) & (
        F.col("own") | ((F.col("score") >= V.OFFSITE_MIN_SCORE) & ~F.col("d.denied"))))
    best = hits.groupBy(site, "url").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return top_per_key(best, [site], [F.col("score").desc(), F.col("pos")], top, rank="rank") \
        .select(site, "rank", "url", "score")


def homepage_job_boards(homes: DataFrame, site: str = "site") -> DataFrame:
    """Job boards a home page's careers links lead to: site, job_board."""
    return (_scored(homes, site).filter(~F.col("own") & (F.col("score") >= V.OFFSITE_MIN_SCORE)
                                        & F.col("d.board").isNotNull())
            .select(site, F.col("d.board").alias("job_board")).distinct())


def _scored(homes: DataFrame, site: str) -> DataFrame:
    links = computed(anchors(homes, [site, "domains"]),
                     text=TX.collapse(F.array_join("chunks", " ")))
    url, text = F.col("url"), F.col("text")
    asked = F.concat(U.path(url), F.when(U.query(url) != "", F.concat(F.lit("?"), U.query(url))).otherwise(""))
    scored = computed(links.filter(U.scheme(url).isin("http", "https")), score=link_score(asked, text),
                      own=U.on_site(U.host(url), F.col("domains")), d=U.denied_host(U.host(url)))
    return scored.select(site, "pos", "url", "score", "own", "d")


def probes(sites: DataFrame, links: DataFrame, site: str = "site") -> DataFrame:
    """Addresses to look at per site with the best score each got: links, common paths, subdomains, the typed address.

    sites: site, root_url, domain, input_url; links: site, url, score.
    """
    common = F.array(*[F.struct(F.concat(F.rtrim("root_url", F.lit("/")), F.lit("/" + p)).alias("url"),
                                F.lit(15).alias("score"), F.lit(f"common path /{p}").alias("reason"))
                       for p in V.PROBE_PATHS])
    subs = F.array(*[F.struct(F.concat(F.lit(f"https://{s}."), "domain", F.lit("/")).alias("url"), F.lit(0).alias("score"),
                              F.concat(F.lit(f"{s}."), "domain", F.lit(" subdomain")).alias("reason"))
                     for s in ("careers", "jobs")])
    typed = F.array(F.struct(F.col("input_url").alias("url"), F.lit(80).alias("score"),
                             F.lit("address you entered").alias("reason")))
    has_path = F.btrim(U.path(F.col("input_url")), F.lit("/")) != ""
    fixed = sites.select(site, F.explode(F.concat(
        F.when(has_path, typed).otherwise(F.slice(typed, 1, 0)), common, subs)).alias("p")).select(site, "p.*")
    linked = links.select(site, "url", F.col("score").cast("int"), F.lit("homepage link").alias("reason"))
    # equal scores: the typed address, then links, then common paths, then subdomains were asked for first
    source = (F.when(F.col("reason") == "address you entered", 3).when(F.col("reason") == "homepage link", 2)
              .when(F.col("score") > 0, 1).otherwise(0))
    return (fixed.unionByName(linked).groupBy(site, "url")
            .agg(F.max_by(F.struct("score", "reason"), F.struct(F.col("score"), source)).alias("b"))
            .select(site, "url", "b.*"))


def final_score(final_url: Column, base: Column) -> Column:
    """Base score adjusted by what the address itself says."""
    host, path = U.host(final_url), U.path(final_url)
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    return (base + F.when(host.rlike(V.ATS_HOST), 60).otherwise(0)
            + F.when(path.rlike(V.EXACT_CAREERS_PATH), 50).otherwise(0)
            + F.when(F.startswith(host, F.lit("careers.")) | F.startswith(host, F.lit("jobs.")), 45).otherwise(0)
            - F.when(U.non_english_locale(path), 40).otherwise(0) - 3 * depth)


def looks_like_home(final_url: Column, title: Column, size: Column, home_url: Column, home_title: Column,
                    home_size: Column) -> Column:
    """A soft 404: the home page's own address, or its title with nearly its size."""
    near = F.abs(size - home_size) <= 0.03 * F.greatest(home_size, F.lit(1))
    return F.coalesce((U.url_key(final_url) == U.url_key(home_url)) | ((title != "") & (title == home_title) & near),
                      F.lit(False))


def page_features(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Small columns about each page, so that later joins and shuffles never move the markup."""
    html = F.col("html")
    small = computed(pages.select(*keep, "final_url", "status", "html"), title=C.page_title(html),
                     size=F.length(html), challenge=C.is_challenge(html),
                     loaded=F.coalesce((F.col("status") == 200) & (html != ""), F.lit(False)))
    return small.withColumn("ok", F.col("loaded") & ~F.col("challenge")).drop("loaded", "html")


def merged_candidates(features: DataFrame, homes: DataFrame, site: str = "site", bucket_width: int = 100_000) -> DataFrame:
    """All careers-page candidates per site: site, url_key, pos, final_url, is_blocked, hosted_elsewhere, score, hits.

    features: site, pos (order asked for), url, final_url, status, title, size, challenge, ok, base_score, asked_for,
    domains; homes: site, home_url, home_title, home_size (rows of unusable home pages left out). Pages with the same
    URL key merge: each further one lifts the better score by five, one after the other. With n pages that is
    max over i of score_i + 5 * (n + 1 - max(i, 2)), so no list has to be collected.
    """
    f = features.join(homes, site, "left")
    path, host = U.path(F.col("final_url")), U.host(F.col("final_url"))
    blocked = C.is_blocked(F.col("status"), F.col("challenge")) & (F.col("asked_for") | path.rlike(V.CAREERS_PATH))
    fine = (F.col("ok") & ~C.not_found_title(F.col("title")) & ~looks_like_home(
        F.col("final_url"), F.col("title"), F.col("size"), F.col("home_url"), F.col("home_title"), F.col("home_size")))
    careers = C.careers_looking(F.col("title"), path)
    on_ats = host.rlike(V.ATS_HOST)
    elsewhere = ~U.on_site(host, F.col("domains")) & ~on_ats
    allowed = ~F.col("denied") & F.when(F.col("is_blocked"), F.col("asked_for")).otherwise(F.col("careers"))
    kept = (computed(f, is_blocked=blocked, fine=fine, careers=careers, on_ats=on_ats, elsewhere=elsewhere,
                     denied=U.denied_host(host)["denied"])
            .filter(F.col("is_blocked") | F.col("fine")).filter(~F.col("elsewhere") | allowed)
            .filter(F.col("on_ats") | F.col("careers") | F.col("is_blocked"))
            .select(site, "pos", "final_url", "is_blocked", F.when(F.col("elsewhere"), host).alias("hosted_elsewhere"),
                    U.url_key(F.col("final_url")).alias("url_key"),
                    final_score(F.col("final_url"), F.col("base_score")).alias("score")))
    placed = ordinal(kept, [site, "url_key"], "pos", F.floor(F.col("pos") / bucket_width), "nth")
    merged = placed.groupBy(site, "url_key").agg(
        F.count("*").alias("hits"),
        F.max(F.col("score") - 5 * F.greatest(F.col("nth"), F.lit(2))).alias("lead"), F.max("score").alias("best"),
        F.min("pos").alias("pos"),
        F.min_by(F.struct("final_url", "is_blocked", "hosted_elsewhere"), "pos").alias("page"))
    score = F.when(F.col("hits") == 1, F.col("best")).otherwise(F.col("lead") + 5 * (F.col("hits") + 1))
    return merged.select(site, "url_key", "pos", "page.*", score.alias("score"), "hits")


def best_candidates(merged: DataFrame, top: int, site: str = "site") -> DataFrame:
    """The `top` candidates of each site, best first, with their rank."""
    return top_per_key(merged, [site], [F.col("score").desc(), F.col("pos")], top, rank="rank")


def careers_domains(found: DataFrame, site: str = "site", domain: str = "domain") -> DataFrame:
    """The domains that count as a company's own: its domain and every careers site it hands over to.

    found: all candidates, not the best few only, so that no hand-over is missed.
    """
    own = found.select(site, F.col(domain).alias("careers_domain"))
    grown = found.filter(F.col("hosted_elsewhere").isNotNull()).select(
        site, U.registrable_domain(F.col("hosted_elsewhere")).alias("careers_domain"))
    return own.union(grown).distinct()
