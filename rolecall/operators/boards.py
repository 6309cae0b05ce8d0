"""Which hiring platform is behind a company's pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX, urls as U, vocab as V
from .keyed import computed, first_per_key, top_per_key

_HINT = (r"(?i)greenhouse\.io|lever\.co|ashbyhq\.com|smartrecruiters\.com|myworkdayjobs\.com|oraclecloud\.com")


def page_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and `text`: addresses and markup of each page with references and escapes undone."""
    joined = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("final_url", F.lit("")),
                         F.array_join(F.coalesce("json_urls", F.array().cast("array<string>")), " "), F.coalesce("html", F.lit("")))
    return computed(pages.select(*keep, "url", "final_url", "json_urls", "html"), text=TX.prepare(joined)).select(*keep, "text")


def _hit(match: Column, nth: Column, number: int) -> Column:
    """One match of a pattern as the board it names."""
    ats, pattern, groups, lower = V.BOARD_PATTERNS[number]
    parts = [F.regexp_extract(match, pattern, g) for g in groups]
    if len(groups) == 2:
        token = F.concat(F.lower(parts[0]), F.lit("/"), parts[1])
    else:
        token = F.btrim(F.coalesce(F.try_url_decode(parts[0]), parts[0]), F.lit("._-"))
        token = F.lower(token) if lower else token
    return F.struct(F.lit(ats).alias("ats"), token.alias("token"), match.alias("match"), F.lit(number).alias("pattern"), nth.alias("nth"))


def _hits(text: Column, number: int) -> Column:
    matches = F.regexp_extract_all(text, F.lit(V.BOARD_PATTERNS[number][1]), F.lit(0))
    return F.transform(matches, lambda match, nth: _hit(match, nth, number))


def _is_board(ats: Column, token: Column) -> Column:
    """Does a hit name a company's board, not a page of the platform itself?"""
    site = F.lower(F.substring_index(token, "/", -1))
    ignored = F.lit(False)
    for name, tokens in V.IGNORED_TOKENS.items():
        ignored = ignored | ((ats == name) & F.lower(token).isin(tokens))
    return (token != "") & ~ignored & ~((ats == "workday") & site.isin(V.IGNORED_WORKDAY_SITES))


def mentions(pages: DataFrame, domain: str, order: str) -> DataFrame:
    """Every mention of a readable board: domain, order, ats, token, match, pattern, nth. Most pages stop at one test."""
    text = page_text(pages, [domain, order]).filter(F.col("text").rlike(_HINT))
    rows = text.select(domain, order, F.inline(F.concat(*[_hits(F.col("text"), i) for i in range(len(V.BOARD_PATTERNS))])))
    return rows.filter(_is_board(F.col("ats"), F.col("token")))


def detections(pages: DataFrame, sites: DataFrame, top: int, domain: str = "domain", order: str = "pos") -> DataFrame:
    """The `top` boards per company, best first: domain, rank, ats, token, hits, extra. sites: domain, slug.

    A token that matches the company's name beats any number of mentions; equals keep the order first seen.
    """
    seen = F.struct(order, "pattern", "nth")
    counted = mentions(pages, domain, order).groupBy(domain, "ats", F.lower("token").alias("__key")).agg(
        F.count("*").alias("hits"), F.min_by(F.struct("token", "match"), seen).alias("m"), F.min(seen).alias("__seen"))
    named = counted.select(domain, "ats", "m.*", "hits", "__seen").join(sites.select(domain, "slug"), domain, "left")
    score = F.col("hits") + F.when(TX.names_match(F.substring_index("token", "/", 1), F.col("slug")), V.NAME_MATCH_BONUS).otherwise(0)
    ranked = top_per_key(named, [domain], [score.desc(), F.col("__seen")], top, rank="rank")
    return ranked.select(domain, "rank", "ats", "token", "hits", _extra(F.col("ats"), F.col("match")).alias("extra"))


def _extra(ats: Column, match: Column) -> Column:
    """Parts of the address a reader needs."""
    wd, oracle = V.BOARD_PATTERNS[10][1], V.BOARD_PATTERNS[11][1]
    return (F.when(ats == "workday", F.create_map(
                F.lit("tenant"), F.lower(F.regexp_extract(match, r"(?i)^([a-z0-9-]+)\.wd", 1)),
                F.lit("wd"), F.lower(F.regexp_extract(match, r"(?i)\.(wd\d+)\.", 1)),
                F.lit("site"), F.regexp_extract(match, r"([A-Za-z0-9_-]+)$", 1)))
            .when(ats == "oracle", F.create_map(
                F.lit("host"), F.lower(F.regexp_extract(match, r"^([^/]+)", 1)),
                F.lit("lang"), F.regexp_extract(match, r"(?i)CandidateExperience/([^/]+)", 1),
                F.lit("site"), F.regexp_extract(match, oracle, 2)))
            .when(ats == "lever", F.create_map(F.lit("region"), F.when(match.rlike(r"(?i)\.eu\.lever"), "eu").otherwise(""))))


def unsupported_vendors(pages: DataFrame, domain: str = "domain", order: str = "pos") -> DataFrame:
    """Platforms named on the pages that no reader exists for, and whether a gh_jid link was seen: domain, vendors, saw_gh_jid.

    A page's text is made once and asked for everything; the readable boards on it (see `mentions`) come as flags too.
    """
    text, readers = F.col("text"), sorted({ats for ats, *_ in V.BOARD_PATTERNS})
    hits = F.concat(*[_hits(text, i) for i in range(len(V.BOARD_PATTERNS))])
    boards = F.transform(F.filter(hits, lambda h: _is_board(h["ats"], h["token"])), lambda h: h["ats"])
    pages = computed(page_text(pages, [domain, order]), __ats=F.when(text.rlike(_HINT), F.array_distinct(boards)))
    flags = {v: F.bool_or(text.rlike(p)) for v, p in V.UNSUPPORTED_VENDORS.items()}
    # a company without a domain has no readers: it is joined with nothing
    read = {a: F.bool_or(F.array_contains("__ats", a) & F.col(domain).isNotNull()) for a in readers}
    seen = pages.groupBy(domain).agg(*[f.alias(v) for v, f in flags.items()], *[f.alias(f"__{a}") for a, f in read.items()],
                                     F.bool_or(text.rlike(V.GH_JID)).alias("saw_gh_jid"))
    unread = {v: F.col(v) & ~F.coalesce(F.col(f"__{v}"), F.lit(False)) if v in read else F.col(v) for v in sorted(flags)}
    return seen.select(domain, F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in unread.items()])).alias("vendors"), "saw_gh_jid")


def vendor_links(pages: DataFrame, domain: str = "domain", order: str = "pos") -> DataFrame:
    """The best address of each unsupported platform seen on a company's pages: domain, vendor, url.

    Addresses in the markup come first, in order, then the page's own.
    """
    text = computed(pages.select(domain, order, "final_url", "html"), text=TX.prepare(F.coalesce("html", F.lit(""))))
    urls = text.select(domain, order, F.posexplode(F.concat(
        F.regexp_extract_all("text", F.lit(V.URL_IN_TEXT), F.lit(0)), F.array(F.coalesce("final_url", F.lit(""))))).alias("nth", "url"))
    vendors = F.array_compact(F.array(*[F.when(F.col("url").rlike(p), F.lit(v)) for v, p in V.UNSUPPORTED_VENDORS.items()]))
    hits = urls.withColumn("url", F.rtrim("url", F.lit("."))).select(domain, order, "nth", "url", F.explode(vendors).alias("vendor"))
    u = F.col("url")
    score = sum((F.when(u.rlike(pattern), points).otherwise(0) for pattern, points in V.VENDOR_ADDRESS_SCORES), F.lit(0))
    return first_per_key(hits.withColumn("__score", score), [domain, "vendor"],
                         [F.col("__score").desc(), F.col(order), F.col("nth")]).select(domain, "vendor", "url")


def confirmed_guesses(guesses: DataFrame, sites: DataFrame) -> DataFrame:
    """Guessed boards that are the company's: title matches its name, or a job's URL is on its site.

    guesses: domain, ats, board_name, url (one row per job); sites: domain, slug, domains. First platform tried wins.
    """
    own = U.on_site(U.host(F.col("url")), F.col("domains"))
    rank = F.array_position(F.array(*[F.lit(a) for a in V.GUESSABLE_BOARDS]), F.col("ats"))
    judged = (guesses.filter(F.col("ats").isin(V.GUESSABLE_BOARDS)).join(sites, "domain")
              .groupBy("domain", "ats").agg(F.bool_or(own | TX.names_match(F.col("board_name"), F.col("slug"))).alias("ok"),
                                            F.count("*").alias("jobs"), F.min(rank).alias("__rank")))
    return first_per_key(judged.filter("ok"), ["domain"], [F.col("__rank")]).select("domain", "ats", "jobs")
