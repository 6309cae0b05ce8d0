"""SQL fragments for the checking side, written for DuckDB and its regular expressions (RE2)."""
from __future__ import annotations

from ..functions import vocab as V

# What the given texts and pages hold of these; all others are compared with rows written by hand.
EXPANSIONS = {"ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "…": "", "™": "tm", "№": "no"}
NAMED_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
                  "middot": "·", "bull": "•", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
                  "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ouml": "ö", "uuml": "ü",
                  "auml": "ä", "szlig": "ß", "ntilde": "ñ", "oacute": "ó", "aacute": "á", "sol": "/", "colon": ":", "period": ".",
                  "quest": "?", "equals": "=", "lowbar": "_", "comma": ","}
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A library pattern for RE2: there `(?U)` means something else and is dropped."""
    return lit(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def pick(values: list, key: str) -> str:
    items = ", ".join("NULL" if v is None else lit(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[({key}) % {len(values)} + 1]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def clean(x: str) -> str:
    return f"nullif({collapse(x)}, '')"


def fold(x: str) -> str:
    for char, plain in EXPANSIONS.items():
        x = f"replace({x}, {lit(char)}, {lit(plain)})"
    return (f"trim(regexp_replace(replace(replace(replace(lower(strip_accents({x})), '.', ''), '''', ''), '’', ''), "
            f"'{WS}', ' ', 'g'))")


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def title_case(x: str) -> str:
    runs = f"regexp_extract_all({x}, '([\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+)')"
    return (f"array_to_string(list_transform({runs}, lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')")


def alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def names_match(a: str, b: str) -> str:
    a, b = alnum(f"coalesce({a}, '')"), alnum(f"coalesce({b}, '')")
    return (f"(CASE WHEN length({a}) < 3 OR length({b}) < 3 THEN {a} = {b} AND {a} <> '' "
            f"ELSE contains({a}, {b}) OR contains({b}, {a}) END)")


def has_word(x: str, *words: str) -> str:
    import re
    either = "|".join(re.escape(w) for w in words)
    return f"coalesce(regexp_matches({x}, {lit(rf'(?i)(^|[^\p{{L}}\p{{N}}_])({either})($|[^\p{{L}}\p{{N}}_])')}), false)"


def unescape(x: str) -> str:
    for name, char in NAMED_ENTITIES.items():
        x = f"replace({x}, '&{name};', {lit(char)})"
    return f"replace({x}, '&amp;', '&')"


# ---- URLs ----

def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def host(u: str) -> str:
    return (f"lower(regexp_extract({u}, "
            f"'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1))")


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def url_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '^[^#]*#(.*)$', 1, 's')"


def without_fragment(u: str) -> str:
    return f"split_part({u}, '#', 1)"


def url_key(u: str) -> str:
    u = f"coalesce({u}, '')"
    ids = f"regexp_extract_all({url_query(u)}, '(?:^|&)(gh_jid=[^&]+)', 1)"
    frag = fragment(u)
    return (f"(regexp_replace({host(u)}, '^www\\.', '') || rtrim({path(u)}, '/') || "
            f"CASE WHEN len({ids}) > 0 THEN '?' || array_to_string({ids}, '&') ELSE '' END || "
            f"CASE WHEN regexp_matches({frag}, {re2(V.JOB_FRAGMENT)}) THEN '#' || {frag} ELSE '' END)")


def registrable_domain(h: str) -> str:
    labels = f"string_split(rtrim(lower(coalesce({h}, '')), '.'), '.')"
    return (f"array_to_string(CASE WHEN len({labels}) >= 3 AND {labels}[-2] IN {in_list(V.SECOND_LEVEL)} "
            f"AND length({labels}[-1]) = 2 THEN {labels}[-3:] ELSE {labels}[-2:] END, '.')")


def site_domain(u: str) -> str:
    return registrable_domain(host(u))


def same_site(h: str, d: str) -> str:
    return f"(lower({h}) = {d} OR suffix(lower({h}), '.' || {d}))"


def non_english_locale(p: str) -> str:
    one, two = f"lower(split_part({p}, '/', 2))", f"lower(split_part({p}, '/', 3))"
    seg = re2(V.LOCALE_SEGMENT)
    return (f"(regexp_matches({one}, {seg}) AND NOT regexp_matches({one}, '^en([-_]|$)') AND NOT "
            f"(regexp_matches({two}, {seg}) AND regexp_matches({two}, '^en([-_]|$)')))")


# ---- classification ----

def workplace_of(x: str) -> str:
    t = f"lower({clean(x)})"
    return (f"(CASE WHEN {t} IN {in_list(V.UNSPECIFIED)} THEN NULL "
            f"WHEN contains({t}, 'hybrid') OR {t} = 'flex' OR contains({t}, 'flexible') THEN 'hybrid' "
            f"WHEN contains({t}, 'remote') OR contains({t}, 'telecommute') OR contains({t}, 'work from home') "
            f"THEN 'remote' WHEN regexp_matches({t}, {re2(V.ONSITE)}) OR {t} IN {in_list(V.ONSITE_EXACT)} "
            f"THEN 'onsite' END)")


def workplace_from_text(location: str, title: str) -> str:
    t = f"(coalesce({location}, '') || ' ' || coalesce({title}, ''))"
    r, h = f"regexp_matches({t}, {re2(V.REMOTE)})", f"regexp_matches({t}, {re2(V.HYBRID)})"
    return f"(CASE WHEN {r} AND {h} THEN NULL WHEN {h} THEN 'hybrid' WHEN {r} THEN 'remote' END)"


def employment_type_of(x: str) -> str:
    t = clean(x)
    return (f"(CASE WHEN {t} IS NULL OR lower({t}) IN {in_list(V.UNSPECIFIED)} THEN NULL "
            f"WHEN regexp_matches({t}, {re2(V.INTERN)}) THEN 'intern' "
            f"WHEN regexp_matches({t}, {re2(V.PART_TIME)}) THEN 'part_time' "
            f"WHEN regexp_matches({t}, {re2(V.FULL_TIME)}) THEN 'full_time' "
            f"WHEN regexp_matches({t}, {re2(V.CONTRACT)}) THEN 'contract' ELSE 'other' END)")


def page_title(html: str) -> str:
    return collapse(unescape(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def is_challenge(html: str) -> str:
    title = collapse(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return (f"({html} <> '' AND (regexp_matches({title}, {re2(V.CHALLENGE_TITLE)}) OR "
            f"(len(regexp_extract_all({html}, '(?i)<a ')) < "
            f"{V.CHALLENGE_MAX_LINKS} AND regexp_matches({html}, {re2(V.CHALLENGE_BODY)}))))")


def visible_text(html: str) -> str:
    hidden = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
              r"|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>")
    return collapse(unescape(f"regexp_replace(regexp_replace({html}, {lit(hidden)}, ' ', 'g'), '<[^>]*>', ' ', 'g')"))


def base_source(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '\\s*\\(by name\\)$', '')"


def resolve(base: str, href: str) -> str:
    """Absolute URL of a link (the tables hold no '.' or '..' steps)."""
    h = f"trim({href})"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_extract({path(base)}, '^(.*/)', 1), ''), '/')"
    return (f"(CASE WHEN {h} = '' THEN {base} WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme(base)} || ':' || {h} "
            f"WHEN starts_with({h}, '#') THEN {without_fragment(base)} || {h} "
            f"WHEN starts_with({h}, '?') THEN {origin} || {path(base)} || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} ELSE {origin} || {folder} || {h} END)")


_STEP = r"/(?:jobs?|careers?|positions?|openings?|vacanc(?:y|ies)|roles?|requisitions?|opportunit(?:y|ies))/"


def is_job_link(url: str, domains: str, listing: str) -> str:
    segments = f"regexp_extract_all({path(url)}, {re2(V.JOB_STEP)}, 1)"
    direct = (f"len(list_filter({segments}, lambda s: lower(s) NOT IN {in_list(V.LISTING_SEGMENTS + V.NAV_SEGMENTS)} "
              f"AND NOT regexp_matches(lower(s), '{V.NAV_PREFIX}'))) > 0")
    listed = f"regexp_matches({path(url)}, '(?i){_STEP}(?:search|list|listing|listings)/+[^/]*[0-9]')"
    return (f"({scheme(url)} IN ('http', 'https') AND len(list_filter({domains}, lambda d: {same_site(host(url), 'd')})) > 0 "
            f"AND {url_key(url)} <> {url_key(listing)} AND NOT regexp_matches({url}, '[?&]page=') "
            f"AND ({direct} OR {listed} OR regexp_matches('?' || {url_query(url)}, {re2(V.JOB_QUERY)})))")


def anchors(source: str, keep: str) -> str:
    """CTE body: links of the pages in `source` (needs html, final_url)."""
    quoted = """<a\\s(?:[^>=]+|=\\s*"[^"]*"|=\\s*'[^']*'|=)*>"""
    opening = f"regexp_extract(tag, {lit('(?is)^' + quoted)})"
    found = lit("""(?is)[\\s"']href\\s*=\\s*(?:"([^"]*)"|'([^']*)'|([^\\s"'>]+))""")
    href = " || ".join(f"regexp_extract({opening}, {found}, {g})" for g in (1, 2, 3))
    inner = f"regexp_extract(tag, {lit('(?is)^' + quoted + '(.*)</a' + chr(92) + 's*>$')}, 1)"
    unseen = "'(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>'"
    tags = f"regexp_extract_all(regexp_replace(html, {unseen}, ' ', 'g'), {lit('(?is)' + quoted + '.*?</a' + chr(92) + 's*>')})"
    return f"""SELECT {keep}, final_url, pos, href, {without_fragment(resolve('final_url', 'href'))} AS url, chunks FROM (
        SELECT {keep}, final_url, pos, {unescape(f'({href})')} AS href,
               list_filter(list_transform(regexp_split_to_array({inner}, '<[^>]*>'), lambda x: {clean(unescape('x'))}),
                           lambda x: x IS NOT NULL) AS chunks
        FROM (SELECT {keep}, final_url, unnest(range(len(tags))) AS pos, unnest(tags) AS tag
              FROM (SELECT {keep}, final_url, {tags} AS tags FROM {source}))
        WHERE regexp_matches({opening}, {found}))"""
