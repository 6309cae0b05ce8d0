"""Forgetting and rebuilding: each function returns the tables as they should be written next."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .history import number_rows
from .keyed import first_per_key, top_per_key


def prune(runs: DataFrame, postings: DataFrame, run_postings: DataFrame, now: Column,
          keep_runs: int, closed_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep the newest runs per company (running ones always) and postings not closed for longer than the limit.

    Returns runs, postings, run_postings. Postings that are still listed are never dropped.
    """
    finished = runs.filter(F.coalesce("status", F.lit("")) != "running")
    newest = top_per_key(finished, ["domain"], [F.col("run_id").desc()], keep_runs)
    kept_runs = runs.filter(F.col("status") == "running").unionByName(newest)
    too_old = F.coalesce(F.col("closed_at") < now - F.expr(f"INTERVAL {closed_days} DAYS"), F.lit(False))
    kept_postings = postings.filter(~too_old)
    # what is dropped is the smaller side by far: links are filtered by absence from it
    dropped_runs = finished.join(newest.select("run_id"), "run_id", "left_anti").select("run_id")
    links = (run_postings.join(dropped_runs, "run_id", "left_anti")
             .join(postings.filter(too_old).select("posting_id"), "posting_id", "left_anti"))
    return kept_runs, kept_postings, links.select(*run_postings.columns)


def prune_counts(runs: DataFrame, postings: DataFrame, run_postings: DataFrame, kept: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """How many rows each table loses."""
    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")

    before = size(runs, "runs").union(size(postings, "postings")).union(size(run_postings, "run_postings"))
    after = size(kept[0], "runs").union(size(kept[1], "postings")).union(size(kept[2], "run_postings"))
    return (before.unionByName(after.withColumn("n", -F.col("n"))).groupBy("table").agg(F.sum("n").alias("removed")))


def expire_pages(pages: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """Stored pages young enough to be used again."""
    return pages.filter(F.col("fetched_at") >= now - F.expr(f"INTERVAL {max_age_seconds} SECONDS"))


def backfill_workplace(jobs: DataFrame) -> DataFrame:
    """Old rows knew only remote or not: 1 really meant remote, 0 may have been hybrid and stays unknown."""
    return jobs.withColumn("workplace", F.coalesce("workplace", F.when(F.col("remote") == 1, "remote")))


def postings_from_jobs(jobs: DataFrame, runs: DataFrame, seen: DataFrame, now: Column, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Old layout (one row per run and job) -> postings and links.

    jobs: id, run_id, url_key, is_new, fields; seen: url_key, first_seen. A posting holds the newest copy's fields;
    first seen is what `seen` says, else its earliest listing run's start, else now.
    """
    named = jobs.filter(F.coalesce("url_key", F.lit("")) != "")
    starts = runs.select("run_id", "domain", "started_at", "finished_at")
    first_listed = (named.select("url_key", "run_id").join(starts.select("run_id", "started_at"), "run_id")
                    .groupBy("url_key").agg(F.min("started_at").alias("first_listed")))
    newest = first_per_key(named, ["url_key"], [F.col("id").desc()]).select("url_key", "run_id", *fields)
    postings = (newest.join(starts, "run_id").join(first_listed, "url_key", "left").join(seen, "url_key", "left")
                .select("url_key", "domain", *fields, F.coalesce("first_seen", "first_listed", now).alias("first_seen"),
                        F.coalesce("finished_at", "started_at", now).alias("last_seen"), F.col("run_id").alias("last_run_id")))
    numbered = number_rows(postings, "url_key", "posting_id")
    links = (named.join(numbered.select("url_key", "posting_id"), "url_key").groupBy("run_id", "posting_id")
             .agg(F.max(F.coalesce("is_new", F.lit(0))).alias("is_new")))
    return numbered, links


def feed_since(events: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """Change feed: everything from a cursor on."""
    return events.filter(F.col(order) >= cursor)


def trim_feed(events: DataFrame, trim_at: int, keep: int, order: str = "event_id") -> DataFrame:
    """The feed after its trims: when it grows past `trim_at`, only the newest `keep` stay.

    Ids grow by one, so the surviving range follows from the first and last id alone.
    """
    edge = events.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    size = F.col("hi") - F.col("lo") + 1
    # the first trim happens at trim_at + 1 events, each later one after another (trim_at - keep + 1)
    step = trim_at - keep + 1
    trims = F.when(size <= trim_at, 0).otherwise(F.floor((size - trim_at - 1) / step) + 1)
    start = F.col("lo") + F.when(trims == 0, 0).otherwise((trim_at + 1 - keep) + (trims - 1) * step)
    return events.join(F.broadcast(edge.select(start.alias("__from"))), F.col(order) >= F.col("__from")).drop("__from")
