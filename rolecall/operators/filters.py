"""Filters, facets, sorting and paging over postings."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as DT, text as TX
from ..schemas import EMPLOYMENT_TYPES, FACETS, UNKNOWN, WORKPLACES
from ..sources.gazetteer import Gazetteer
from .keyed import computed, ordinal, top_per_key
from .search import FIELDS, Search, matches, tokens

NULLABLE = {"workplace", "employment_type", "country", "department"}
SORTS = {"posted": ("posted", True), "title": ("title", True), "company": ("company", True), "location": ("location", True),
         "found": ("posting_id", False), "first_seen": ("first_seen", False), "last_seen": ("last_seen", False)}


@dataclass(frozen=True)
class JobFilter:
    """What a person chose. Every list may hold "unknown", which also means "not stated"."""

    workplace: Sequence[str] = ()
    employment_type: Sequence[str] = ()
    country: Sequence[str] = ()
    region_group: Sequence[str] = ()
    department: Sequence[str] = ()
    source: Sequence[str] = ()
    domain: Sequence[str] = ()
    posted_within_days: int | None = None
    new_only: bool = False
    search: Search = field(default_factory=Search)
    as_of: datetime | None = None

    def checked(self, gazetteer: Gazetteer) -> JobFilter:
        """Values in their stored spelling; ValueError for values that mean nothing."""
        for name, allowed in (("workplace", WORKPLACES), ("employment_type", EMPLOYMENT_TYPES)):
            bad = [v for v in getattr(self, name) if v.lower() not in allowed and v.lower() != UNKNOWN]
            if bad:
                raise ValueError(f"unknown {name}: {', '.join(bad)}")
        groups = [gazetteer.find_group(g) for g in self.region_group]
        if None in groups:
            raise ValueError(f"unknown region group: {self.region_group[groups.index(None)]}")
        if self.posted_within_days is not None and (self.as_of is None or not 1 <= self.posted_within_days <= 3650):
            raise ValueError("posted_within_days needs as_of and must be between 1 and 3650")
        countries = [UNKNOWN if c.lower() == UNKNOWN else gazetteer.country_code(c) or c.upper() for c in self.country]
        return JobFilter([v.lower() for v in self.workplace], [v.lower() for v in self.employment_type], countries, groups,
                         list(self.department), list(self.source), list(self.domain), self.posted_within_days, self.new_only,
                         self.search, self.as_of)


def in_values(c: Column, values: Sequence[str], nullable: bool) -> Column:
    """One of the values; "unknown" also matches NULL where NULL can occur, and nothing where it cannot."""
    wanted = [v for v in values if v != UNKNOWN]
    parts = ([F.coalesce(c.isin(wanted), F.lit(False))] if wanted else []) + (
        [c.isNull()] if UNKNOWN in values and nullable else [])
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def region_condition(countries: Sequence[str], groups: Sequence[str], gazetteer: Gazetteer, country: Column,
                     location: Column) -> Column:
    """Countries, "unknown", members of groups and texts naming a group add up: any of them is enough."""
    members = {c for g in groups for c in gazetteer.group_countries(g)}
    wanted = sorted(members | {c for c in countries if c != UNKNOWN})
    words = [a for g in groups for a in gazetteer.group_aliases(g)]
    hit = in_values(country, [*wanted, *([UNKNOWN] if UNKNOWN in countries else [])], True)
    return hit | TX.has_any_word(location, words) if words else hit


def conditions(f: JobFilter, gazetteer: Gazetteer) -> dict[str, Column]:
    """One condition per facet that narrows, and "rest" for everything that is no facet."""
    out: dict[str, Column] = {}
    for name in FACETS:
        values = getattr(f, name)
        if name == "country":
            if f.country or f.region_group:
                out[name] = region_condition(f.country, f.region_group, gazetteer, F.col("country"), F.col("location"))
        elif values and name == "department":
            out[name] = in_values(F.lower("department"), [v.lower() for v in values], True)
        elif values:
            out[name] = in_values(F.col(name), values, name in NULLABLE)
    rest = []
    if f.posted_within_days:
        as_of = F.lit(f.as_of).cast("timestamp_ntz")
        rest.append(DT.within_days(F.col("posted").cast("timestamp_ntz"), f.posted_within_days, as_of))
    if f.new_only:
        rest.append(F.coalesce("is_new", F.lit(False)))
    if f.search.all_of or f.search.none_of:
        rest.append(matches(f.search, {x: F.col(f"__t_{x}") for x in FIELDS}, gazetteer))
    if rest:
        out["rest"] = reduce(lambda a, b: a & b, rest)
    return out


def _with_tokens(df: DataFrame, f: JobFilter) -> DataFrame:
    if not (f.search.all_of or f.search.none_of):
        return df
    return computed(df, **{f"__t_{x}": tokens(F.col(x)) for x in FIELDS})


def apply_filter(df: DataFrame, f: JobFilter, gazetteer: Gazetteer) -> DataFrame:
    """Postings matching every part of the filter."""
    f = f.checked(gazetteer)
    keep = reduce(lambda a, b: a & b, conditions(f, gazetteer).values(), F.lit(True))
    return _with_tokens(df, f).filter(keep).select(*df.columns)


def facets(df: DataFrame, f: JobFilter, gazetteer: Gazetteer, names: Sequence[str] | None = None,
           limit: int | None = None) -> DataFrame:
    """Value counts per facet, each ignoring its own filter only: facet, position, value, count, label.

    One pass: a row failing one condition counts for that condition's facet alone, a row failing two for none, so most
    rows leave before they are spread over the facets. Unknown comes last. All values are given unless the caller wants the
    `limit` most frequent ones; then unknown is placed after that cut.
    """
    f = f.checked(gazetteer)
    names = list(FACETS if names is None else names)
    unknown = [n for n in names if n not in FACETS]
    if unknown:
        raise ValueError(f"unknown facet: {', '.join(unknown)}")
    tests = conditions(f, gazetteer)
    rest = tests.pop("rest", None)
    work = _with_tokens(df, f)
    work = work if rest is None else work.filter(rest)
    failed = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in tests.items()])) if tests else F.array().cast(
        "array<string>")
    work = computed(work.select(*[c for c in work.columns if not c.startswith("__t_")]), __failed=failed)
    work = work.filter(F.size("__failed") <= 1)
    cells = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value"),
                               (F.col("company") if n == "domain" else F.lit(None).cast("string")).alias("label")) for n in names])
    only = F.get("__failed", F.lit(0))
    spread = work.select(F.inline(F.filter(cells, lambda c: only.isNull() | (only == c["facet"]))))
    counted = spread.groupBy("facet", "value").agg(F.count("*").alias("count"), F.max("label").alias("label"))
    if limit is not None:
        counted = top_per_key(counted, ["facet"], [F.col("count").desc(), F.col("value").asc_nulls_first()], limit)
    kept = counted.filter(F.col("value").isNotNull() | F.col("facet").isin(sorted(NULLABLE)))
    # a facet may have any number of values: it is numbered in pieces of equal count and beginning
    unknown, fewer = F.col("value").isNull().alias("u"), (-F.col("count")).alias("c")
    kept = kept.withColumn("__at", F.struct(unknown, fewer, F.col("value")))
    placed = ordinal(kept, ["facet"], "__at", F.struct(unknown, fewer, F.coalesce(F.substring("value", 1, 2), F.lit("")).alias("v")), "position")
    return placed.select("facet", "position", "value", "count", "label")


def matching_counts(df: DataFrame, f: JobFilter, gazetteer: Gazetteer) -> DataFrame:
    """Per company: postings matching, in all, and new among the matching."""
    f = f.checked(gazetteer)
    keep = reduce(lambda a, b: a & b, conditions(f, gazetteer).values(), F.lit(True))
    work = computed(_with_tokens(df, f), __keep=keep)
    return work.groupBy("domain").agg(F.count_if("__keep").alias("matching"), F.count("*").alias("total"),
                                      F.count_if(F.col("__keep") & F.coalesce("is_new", F.lit(False))).alias("new_matching"))


def hidden_by_unknown(df: DataFrame, f: JobFilter, gazetteer: Gazetteer) -> DataFrame:
    """Rows a filter leaves out only because the field is not stated: one count column per narrowing field.

    If no field narrows, nothing is hidden: zero for each of them.
    """
    f = f.checked(gazetteer)
    tests = conditions(f, gazetteer)
    counts = []
    for name in ("workplace", "employment_type", "country"):
        values = list(getattr(f, name)) + (list(f.region_group) if name == "country" else [])
        if UNKNOWN in values or not [v for v in values if v != UNKNOWN]:
            continue
        others = reduce(lambda a, b: a & b, [c for n, c in tests.items() if n != name], F.lit(True))
        counts.append(F.count_if(others & F.col(name).isNull()).alias(name))
    if not counts:
        return df.agg(*[F.lit(0).cast("bigint").alias(n) for n in ("workplace", "employment_type", "country")])
    return _with_tokens(df, f).agg(*counts)


def sort_key(sort: str = "posted", order: str = "desc", key: str = "posting_id") -> list[Column]:
    """Ordering columns: text in lower case, unknown last both ways for posted and the text fields, newest id first."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    name, last = SORTS[sort]
    c = F.lower(name) if sort in ("title", "company", "location") else F.col(key if sort == "found" else name)
    if last:
        first = c.desc_nulls_last() if order == "desc" else c.asc_nulls_last()
    else:
        first = c.desc_nulls_last() if order == "desc" else c.asc_nulls_first()
    return [first, F.col(key).desc()]


def page(df: DataFrame, limit: int, sort: str = "posted", order: str = "desc", offset: int = 0,
         key: str = "posting_id") -> DataFrame:
    """One page of the sorted postings: a bounded top-n per task, never a full sort.

    Each task keeps offset + limit rows, so offsets are for the first pages; `page_after` goes on from any row.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return df.orderBy(*sort_key(sort, order, key)).offset(offset).limit(limit)


def page_after(df: DataFrame, last: tuple, limit: int, sort: str = "posted", order: str = "desc", key: str = "posting_id") -> DataFrame:
    """The page after a row, given as (its sort value, its key): rows before it are filtered out, none is kept for them."""
    value, number = last
    name, unknown_last = SORTS[sort] if sort in SORTS else (None, None)
    ordering = sort_key(sort, order, key)
    c = F.lower(name) if sort in ("title", "company", "location") else F.col(key if sort == "found" else name)
    tie = F.col(key) < F.lit(number)
    if value is None:
        at_end = unknown_last or order == "desc"
        further = (c.isNull() & tie) if at_end else (c.isNotNull() | (c.isNull() & tie))
    else:
        edge = F.lower(F.lit(value)) if sort in ("title", "company", "location") else F.lit(value)
        beyond = (c < edge) if order == "desc" else (c > edge)
        nulls = c.isNull() if unknown_last or order == "desc" else F.lit(False)
        further = beyond | ((c == edge) & tie) | nulls
    return df.filter(F.coalesce(further, F.lit(False))).orderBy(*ordering).limit(limit)
