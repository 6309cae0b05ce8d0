"""URL expressions. Regular expressions are used because `parse_url` raises on the bad addresses crawls are full of."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#([\s\S]*)$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, _NETLOC, 1)


def host(u: Column) -> Column:
    """Lower-case host without user and port; '' when there is none."""
    return F.lower(F.regexp_extract(
        u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PATH, 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, _QUERY, 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, _FRAGMENT, 1)


def without_fragment(u: Column) -> Column:
    return F.substring_index(u, "#", 1)


def url_key(u: Column) -> Column:
    """Comparable form of a URL: no scheme, 'www.' or trailing slash; only gh_jid and a #job-<id> fragment are kept."""
    u = F.coalesce(u, F.lit(""))
    ids = F.regexp_extract_all(query(u), F.lit(r"(?:^|&)gh_jid=([^&]+)"), F.lit(1))
    kept = F.transform(ids, lambda v: F.concat(F.lit("gh_jid="), v))
    return F.concat(
        F.regexp_replace(host(u), r"^www\.", ""),
        F.rtrim(path(u), F.lit("/")),
        F.when(F.size(ids) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
        F.when(fragment(u).rlike(V.JOB_FRAGMENT), F.concat(F.lit("#"), fragment(u))).otherwise(""))


def registrable_domain(h: Column) -> Column:
    """careers.shop.example.co.uk -> example.co.uk."""
    labels = F.split(F.rtrim(F.lower(F.coalesce(h, F.lit(""))), F.lit(".")), r"\.")
    n = F.size(labels)
    second = F.get(labels, n - 2)
    long_suffix = (n >= 3) & second.isin(V.SECOND_LEVEL) & (F.length(F.get(labels, n - 1)) == 2)
    keep = F.when(long_suffix, F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")


def parse_site(raw: Column) -> Column:
    """struct(input_url, root_url, host, domain, slug, name, error); error is set and the rest NULL for a non-address."""
    text = F.trim(raw)
    full = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    h = F.rtrim(host(full), F.lit("."))
    domain = registrable_domain(h)
    label = F.substring_index(domain, ".", 1)
    good = F.contains(h, F.lit("."))
    return F.struct(
        F.when(good, F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "https:")).alias("input_url"),
        F.when(good, F.concat(F.lit("https://"), h, F.lit("/"))).alias("root_url"),
        F.when(good, h).alias("host"),
        F.when(good, domain).alias("domain"),
        F.when(good, F.regexp_replace(label, "[^a-z0-9]", "")).alias("slug"),
        F.when(good, F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))).alias("name"),
        F.when(~F.coalesce(good, F.lit(False)), F.lit("not a valid web address")).alias("error"))


def same_site(h: Column, domain: Column) -> Column:
    """Host equals the domain or lies below it."""
    h = F.lower(F.coalesce(h, F.lit("")))
    return (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))


def on_site(h: Column, domains: Column) -> Column:
    """Host belongs to any of the company's domains (an array)."""
    return F.exists(domains, lambda d: same_site(h, d))


def denied_host(h: Column) -> Column:
    """struct(denied, board): job boards (named) and social sites are never a company's own careers site."""
    domain = registrable_domain(h)
    board = F.lit(None).cast("string")
    for key, label in V.JOB_BOARDS.items():
        board = F.when(domain == key, F.lit(label)).otherwise(board)
    return F.struct((board.isNotNull() | domain.isin(V.SOCIAL_SITES)).alias("denied"), board.alias("board"))


def non_english_locale(p: Column) -> Column:
    """Does a path start with a locale none of whose (at most two) segments is English?"""
    first = F.lower(F.split_part(p, F.lit("/"), F.lit(2)))
    second = F.lower(F.split_part(p, F.lit("/"), F.lit(3)))
    one = first.rlike(V.LOCALE_SEGMENT)
    two = one & second.rlike(V.LOCALE_SEGMENT)
    return one & ~first.rlike("^en([-_]|$)") & ~(two & second.rlike("^en([-_]|$)"))


def _drop_dots(p: Column) -> Column:
    """Remove '.' and '..' steps from an absolute path."""
    steps = F.split(p, "/")
    last = F.element_at(steps, -1)
    folded = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
                        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    joined = F.array_join(folded, "/")
    joined = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    closed = F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(p.rlike(r"/\.\.?(/|$)"), closed).otherwise(p)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of a link on a page."""
    h = F.trim(href)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(h, r"^[^?#]*([\s\S]*)$", 1)
    step = F.regexp_extract(h, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(h == "", base)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
            .when(F.startswith(h, F.lit("#")), F.concat(without_fragment(base), h))
            .when(F.startswith(h, F.lit("?")), F.concat(origin, path(base), h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, _drop_dots(step), tail))
            .otherwise(F.concat(origin, _drop_dots(F.concat(folder, step)), tail)))


def safe_link(u: Column) -> Column:
    """Only absolute http(s) addresses are kept."""
    return F.when(F.trim(u).rlike(r"(?i)^https?://[^/?#\s]+"), F.trim(u))


def job_fragment_url(page_url: Column, ident: Column) -> Column:
    """The page a posting sits on plus #job-<id>, for postings without a page of their own."""
    return F.concat(without_fragment(page_url), F.lit("#job-"), ident)
