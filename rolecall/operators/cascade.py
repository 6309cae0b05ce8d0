"""Choosing among what several readers found for a company."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from .keyed import top_per_key


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key, the first seen among equals: keys, value, count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("count"), F.min(order).alias("__first"))
    return top_per_key(counts, keys, [F.col("count").desc(), F.col("__first")], 1).drop("__first")


def proper_company_name(postings: DataFrame, sites: DataFrame, batch: str = "run_id", order: str = "pos") -> DataFrame:
    """Give a batch's postings the most common own spelling of the company that matches its name, if there is one.

    sites: domain, name, slug. A batch is a run of one company.
    """
    own = postings.join(sites.select("domain", "name", "slug"), "domain")
    named = own.filter((F.col("company") != F.col("name")) & TX.names_match(F.col("company"), F.col("slug")))
    best = most_common(named, [batch], "company", order).select(batch, F.col("company").alias("__proper"))
    return postings.join(best, batch, "left").withColumn("company", F.coalesce("__proper", "company")).drop("__proper")


def first_that_yields(found: DataFrame, domain: str = "domain", priority: str = "priority") -> DataFrame:
    """Of what the readers found (rows tagged with a priority, lowest first), only the first usable reader's rows.

    A reader that found a board without postings marks it with a row whose url is NULL: that settles the company too.
    """
    best = found.groupBy(domain).agg(F.min(priority).alias(priority))
    return found.join(best, [domain, priority], "left_semi").filter(F.col("url").isNotNull())


def trusted(postings: DataFrame, vendors: DataFrame, domain: str = "domain") -> DataFrame:
    """Where a platform without a reader is behind a company, results that are all link guesses are dropped.

    vendors: domain, vendors (array). One flag per company is combined before the shuffle and joined back.
    """
    unreadable = vendors.filter(F.size("vendors") > 0).select(domain)
    guesses = (postings.groupBy(domain).agg(F.bool_and(F.col("source") == "html-heuristic").alias("__all"))
               .filter("__all").select(domain).join(unreadable, domain, "left_semi"))
    return postings.join(guesses, domain, "left_anti")


def merge_generic(embedded: DataFrame, links: DataFrame, details: DataFrame, domain: str = "domain") -> DataFrame:
    """Postings of a company without a board: those embedded in its listing pages, and its links read from their pages.

    embedded: domain, feed columns; links: domain, url, url_key, title, location; details: url_key and the feed columns of
    a detail page's first embedded posting. A link whose page has no posting becomes a row of its own.
    """
    fields = [c for c in embedded.columns if c != domain]
    joined = links.join(details.select("url_key", F.struct(*fields).alias("__d")), "url_key", "left")
    own = {"title": F.col("title"), "url": F.col("url"), "location": F.col("location"), "source": F.lit("html-heuristic")}
    rows = joined.select(domain, *[F.when(F.col("__d").isNotNull(), F.col(f"__d.{f}"))
                                   .otherwise(own.get(f, F.lit(None))).alias(f) for f in fields])
    return embedded.unionByName(rows)
