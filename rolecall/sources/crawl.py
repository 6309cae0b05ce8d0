"""Landed crawl output: pages, stored fetches, address lists, sitemap addresses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import classify as C, urls as U, vocab as V
from ..operators.keyed import first_per_key, top_per_key
from ..schemas import PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The crawl table with its fixed layout; columns that are not used later are never read."""
    return spark.read.format(fmt).schema(PAGES).load(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def reusable(fetches: DataFrame, keys: Sequence[str], now: Column, lifetime: str = "12h") -> DataFrame:
    """The newest stored fetch per address among those young enough and fit for reuse ('off', '1h' or '12h')."""
    age = F.expr(f"INTERVAL {V.REUSE_SECONDS[lifetime]} SECONDS")
    if lifetime == "off":
        return fetches.limit(0)
    fresh = fetches.filter((F.col("fetched_at") >= now - age) & (F.col("fetched_at") <= now)
                           & C.reusable_page(F.col("status"), F.col("html"), F.col("error")))
    return first_per_key(fresh, keys, [F.col("fetched_at").desc()])


def accept_addresses(typed: DataFrame, active: DataFrame) -> DataFrame:
    """Typed addresses (column raw), trimmed and without repeats -> site columns and status added/ignored/invalid.

    active: column domain, the companies being scanned now.
    """
    once = typed.select(F.trim("raw").alias("raw")).filter(F.col("raw") != "").distinct()
    parsed = once.select("raw", U.parse_site(F.col("raw")).alias("s")).select("raw", "s.*")
    busy = active.select("domain", F.lit(True).alias("busy"))
    status = (F.when(F.col("error").isNotNull(), "invalid").when(F.col("busy"), "ignored").otherwise("added"))
    return parsed.join(busy, "domain", "left").withColumn("status", status).drop("busy")


def sitemap_candidates(urls: DataFrame, site: str, top: int) -> DataFrame:
    """Addresses with a path segment naming jobs or careers: shortest path, then shortest address, `top` per site."""
    steps = F.split(U.path(F.col("url")), "/")
    hits = urls.filter(F.arrays_overlap(steps, F.array(*[F.lit(s) for s in V.SITEMAP_SEGMENTS]))).select(site, "url").distinct()
    return top_per_key(hits, [site], [F.size(F.split(U.path(F.col("url")), "/")), F.length("url"), F.col("url")],
                       top, rank="rank").select(site, "rank", "url")
