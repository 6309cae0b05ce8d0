"""Which postings a query looks at: the newest scan of each company, one run, every run, or what has gone."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import posting_status
from ..schemas import LIVE_RUN_STATUSES


def latest_runs(runs: DataFrame, session_id: str | None = None) -> DataFrame:
    """run_id of the newest run per company that is running, done or stopped (within the session, if given)."""
    live = runs.filter(F.col("status").isin(LIVE_RUN_STATUSES))
    if session_id:
        live = live.filter(F.col("session_id") == session_id)
    return live.groupBy("domain").agg(F.max("run_id").alias("run_id")).select("run_id")


def _linked(postings: DataFrame, links: DataFrame) -> DataFrame:
    return postings.join(links, "posting_id")


def current(postings: DataFrame, run_postings: DataFrame, runs: DataFrame, session_id: str | None = None) -> DataFrame:
    """What the newest scan of each company saw; links of older runs are dropped before the large join."""
    newest = run_postings.join(latest_runs(runs, session_id), "run_id", "left_semi")
    return _linked(postings, newest)


def of_run(postings: DataFrame, run_postings: DataFrame, run_id: int) -> DataFrame:
    return _linked(postings, run_postings.filter(F.col("run_id") == run_id))


def of_every_run(postings: DataFrame, run_postings: DataFrame) -> DataFrame:
    return _linked(postings, run_postings)


def gone(postings: DataFrame, run_postings: DataFrame, status: str, runs: DataFrame | None = None,
         session_id: str | None = None) -> DataFrame:
    """Postings that are missing or closed, with the link of the last run that listed them."""
    if status not in ("missing", "closed"):
        raise ValueError("status must be missing or closed")
    state = (F.col("missing_since").isNotNull() & F.col("closed_at").isNull() if status == "missing"
             else F.col("closed_at").isNotNull())
    left = postings.filter(state)
    if session_id:
        scanned = runs.filter(F.col("session_id") == session_id).select("domain").distinct()
        left = left.join(scanned, "domain", "left_semi")
    links = run_postings.withColumnRenamed("run_id", "last_run_id")
    return left.join(links, ["posting_id", "last_run_id"], "left").withColumn(
        "run_id", F.when(F.col("is_new").isNotNull(), F.col("last_run_id")))


def query_columns(scoped: DataFrame) -> DataFrame:
    """The result layout: run id with a fall-back, is_new never unknown, lifecycle columns and status."""
    return (scoped.withColumn("run_id", F.coalesce("run_id", "last_run_id"))
            .withColumn("is_new", F.coalesce("is_new", F.lit(False)))
            .withColumn("status", posting_status(F.col("missing_since"), F.col("closed_at"))))


def matches_per_run(matching: DataFrame, runs: DataFrame) -> DataFrame:
    """How many of each run's postings match; runs without a match get zero."""
    counts = matching.groupBy("run_id").agg(F.count("*").alias("matches"))
    return runs.select("run_id").join(counts, "run_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
