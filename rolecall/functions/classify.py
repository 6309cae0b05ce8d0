"""Classification expressions: ordered CASE expressions over text, pages and counts."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from .text import clean, collapse, unescape_markup
from .variants import let

def _null() -> Column:
    return F.lit(None).cast("string")


def workplace_of(value: Column) -> Column:
    """Any feed wording for where the work is done -> remote, hybrid, onsite or NULL. The order of tests matters."""
    text = F.lower(clean(value))
    return (F.when(text.isin(V.UNSPECIFIED), _null())
            .when(text.contains("hybrid") | (text == "flex") | text.contains("flexible"), F.lit("hybrid"))
            .when(text.contains("remote") | text.contains("telecommute") | text.contains("work from home"),
                  F.lit("remote"))
            .when(text.rlike(V.ONSITE) | text.isin(V.ONSITE_EXACT), F.lit("onsite")))


def workplace_from_text(location: Column, title: Column) -> Column:
    """Remote or hybrid named in the location or title; both named, or neither, is unknown. Never on-site."""
    text = F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(title, F.lit("")))
    remote, hybrid = text.rlike(V.REMOTE), text.rlike(V.HYBRID)
    return F.when(remote & hybrid, _null()).when(hybrid, F.lit("hybrid")).when(remote, F.lit("remote"))


def remote_of(workplace: Column) -> Column:
    return workplace == "remote"


def employment_type_of(value: Column) -> Column:
    """Any feed wording for the kind of contract -> full_time, part_time, contract, intern, other or NULL."""
    return let(clean(value), _employment_type)


def _employment_type(text: Column) -> Column:
    return (F.when(text.isNull() | F.lower(text).isin(V.UNSPECIFIED), _null())
            .when(text.rlike(V.INTERN), F.lit("intern")).when(text.rlike(V.PART_TIME), F.lit("part_time"))
            .when(text.rlike(V.FULL_TIME), F.lit("full_time")).when(text.rlike(V.CONTRACT), F.lit("contract"))
            .otherwise(F.lit("other")))


def trusted_type(typed: Column, loose: Column) -> Column:
    """The employment type text; a bare 'type' value counts only when it is real employment vocabulary."""
    def believed(text: Column) -> Column:
        return let(_employment_type(text), lambda kind: F.when(kind.isNotNull() & (kind != "other"), text))

    return F.coalesce(clean(typed), let(clean(loose), believed))


# ---- pages ----

def page_title(html: Column) -> Column:
    """Collapsed title text; '' when there is none."""
    return collapse(unescape_markup(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def is_challenge(html: Column) -> Column:
    """A bot-protection page: by its title, or by a marker in the body of a page with hardly any link."""
    by_title = collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).rlike(V.CHALLENGE_TITLE)
    bare = F.regexp_count(html, F.lit("(?i)<a ")) < V.CHALLENGE_MAX_LINKS
    return F.coalesce((html != "") & (by_title | (bare & html.rlike(V.CHALLENGE_BODY))), F.lit(False))


def is_blocked(status: Column, challenge: Column) -> Column:
    return F.coalesce(status.isin(V.BLOCKED_STATUSES), F.lit(False)) | F.coalesce(challenge, F.lit(False))


def page_ok(status: Column, html: Column, challenge: Column) -> Column:
    return F.coalesce((status == 200) & (html != ""), F.lit(False)) & ~F.coalesce(challenge, F.lit(False))


_HIDDEN = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
           r"|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>")


def visible_text(html: Column) -> Column:
    """Text a reader sees: scripts, styles, comments and drawings dropped, pieces joined by one space."""
    return collapse(unescape_markup(F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), r"<[^>]*>", " ")))


def needs_rendering(status: Column, html: Column, challenge: Column, thorough: bool = False) -> Column:
    """Would the page be better read in a browser: refused, hardly any link; `thorough`: little text or an empty shell."""
    few = F.regexp_count(html, F.lit(r"(?is)<a\s[^>]*?href\s*=")) < V.FEW_LINKS
    thin = few
    if thorough:
        thin = few | (F.length(visible_text(html)) < V.LITTLE_TEXT) | html.rlike(V.SPA_SHELL)
    return F.coalesce(status.isin(V.BLOCKED_STATUSES), F.lit(False)) | (page_ok(status, html, challenge) & thin)


def careers_looking(title: Column, path: Column) -> Column:
    return title.rlike(V.CAREERS_TITLE) | path.rlike(V.CAREERS_PATH)


def not_found_title(title: Column) -> Column:
    return title.rlike(V.NOT_FOUND_TITLE)


def reusable_page(status: Column, html: Column, error: Column) -> Column:
    """May a stored fetch be used again? Failures, challenges and statuses worth a retry may not."""
    bad = status.isin(V.RETRYABLE_STATUSES) | error.isNotNull() | ((status == 200) & is_challenge(html))
    return ~F.coalesce(bad, F.lit(False))


# ---- runs and postings ----

def posting_status(missing_since: Column, closed_at: Column) -> Column:
    return (F.when(closed_at.isNotNull(), F.lit("closed")).when(missing_since.isNotNull(), F.lit("missing"))
            .otherwise(F.lit("open")))


def base_source(source: Column) -> Column:
    """The reader behind a run; a board found by guessing its name counts as the same reader."""
    return F.regexp_replace(F.coalesce(source, F.lit("")), r"\s*\(by name\)$", "")


def run_source(ats: Column, guessed: Column, rows: Column, any_sniffed: Column) -> Column:
    return (F.when(ats.isNotNull() & guessed, F.concat(ats, F.lit(" (by name)"))).when(ats.isNotNull(), ats)
            .when(rows > 0, F.when(any_sniffed, F.lit("json")).otherwise(F.lit("page"))))


def outcome_of(*, stopped: Column, timed_out: Column, rows: Column, unreachable: Column, unsupported: Column,
               candidates: Column, blocked: Column, job_board: Column) -> Column:
    """How a scan ended. `unsupported` and `candidates` are counts, the others flags."""
    return (F.when(stopped & timed_out, F.lit("timed_out")).when(stopped, F.lit("stopped"))
            .when(rows > 0, F.lit("found")).when(unreachable, F.lit("unreachable"))
            .when(unsupported > 0, F.lit("unsupported")).when(candidates > 0, F.lit("no_listings"))
            .when(blocked, F.lit("blocked")).when(job_board, F.lit("no_listings"))
            .otherwise(F.lit("no_careers_page")))
