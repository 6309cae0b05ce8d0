"""Feed rows of any source -> the fixed posting record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, text as TX, urls as U
from ..schemas import EMPLOYMENT_TYPES, POSTING_FIELDS, WORKPLACES
from ..sources.gazetteer import Gazetteer
from .geo import add_places
from .keyed import computed, first_per_key


def conform(feed: DataFrame, gazetteer: Gazetteer, default_company: Column | None = None) -> DataFrame:
    """All posting fields in their fixed form; other columns are kept.

    Workplace: a valid value, else what the wording means, else the remote flag, else what location and title say.
    """
    company = TX.clean(F.col("company"))
    work = computed(feed, company=company if default_company is None else F.coalesce(company, default_company),
                    title=TX.clean(F.col("title")), url=TX.clean(F.col("url")), location=TX.clean(F.col("location")),
                    department=TX.clean(F.col("department")))
    given = F.col("workplace")
    kind = F.col("employment_type")
    flagged = F.when(F.col("remote").isNotNull(), F.when(F.col("remote"), "remote").otherwise("onsite"))
    work = computed(
        work, workplace=F.coalesce(F.when(given.isin(WORKPLACES), given).otherwise(C.workplace_of(given)), flagged,
                                   C.workplace_from_text(F.col("location"), F.col("title"))),
        employment_type=F.when(kind.isin(EMPLOYMENT_TYPES), kind).otherwise(C.employment_type_of(kind)))
    work = work.withColumn("remote", C.remote_of(F.col("workplace")))
    placed = add_places(work, gazetteer)
    return placed.select(*[c for c in placed.columns if c not in POSTING_FIELDS], *POSTING_FIELDS)


def complete_rows(postings: DataFrame) -> DataFrame:
    """Rows that have a title and a link."""
    return postings.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def dedupe(postings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Complete rows, the first per URL key (and the given keys); adds url_key."""
    keyed = computed(complete_rows(postings), url_key=U.url_key(F.col("url")))
    return first_per_key(keyed, [*keys, "url_key"], order)
