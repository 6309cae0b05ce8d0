"""The history of postings: what is new, upserts into the snapshot, and the two-miss rule for missing and closed.

A company's runs do not overlap, so run ids and finish times grow together within a company. Everything about a
posting's absence then follows from the run that listed it last: the marks are looked up per *run* (a small table) and
joined to postings by run id, so no join ever pairs postings with all runs of their company.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C, vocab as V
from ..schemas import POSTING_FIELDS
from .keyed import first_per_key, next_value, previous_value

RUN_BUCKET = 10_000          # run ids per bucket where a company's runs are sorted
TIME_BUCKET_SECONDS = 90 * 86_400


# ---- new or known ----

def first_sightings(listings: DataFrame, key: str = "url_key") -> DataFrame:
    """The whole history at once: every listing with is_new, true where a key is seen for the first time (by run, pos)."""
    first = listings.groupBy(key).agg(F.min(F.struct("run_id", "pos")).alias("__first"))
    return (listings.join(first, key).withColumn("is_new", F.struct("run_id", "pos") == F.col("__first")).drop("__first"))


def mark_new(batch: DataFrame, known: DataFrame, key: str = "url_key") -> DataFrame:
    """One batch: is_new is true for the first row of a key that is no posting yet, by run (if the batch has runs), then pos."""
    place = F.struct(*[c for c in ("run_id", "pos") if c in batch.columns])
    fresh = (batch.filter(F.col(key).cast("string") != "").groupBy(key).agg(F.min(place).alias("__first"))
             .join(known.select(key), key, "left_anti"))
    return (batch.join(fresh, key, "left").withColumn("is_new", F.coalesce(place == F.col("__first"), F.lit(False)))
            .drop("__first"))


def number_rows(df: DataFrame, key: str, into: str, start: int = 1, buckets: int = 1024) -> DataFrame:
    """Dense, repeatable numbers for rows with a unique key: numbered per hash bucket, shifted by the buckets before."""
    work = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    shift = (work.groupBy("__b").agg(F.count("*").alias("__n"))       # at most `buckets` rows
             .select("__b", F.coalesce(before, F.lit(0)).alias("__before")))
    local = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return (work.withColumn("__k", local).join(F.broadcast(shift), "__b")
            .withColumn(into, F.col("__before") + F.col("__k") + F.lit(start - 1)).drop("__b", "__k", "__before"))


# ---- upsert ----

def batch_postings(batch: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A batch reduced to one row per key: the last row's fields, run and domain, when it was seen first, NULL keys left out."""
    fields = POSTING_FIELDS if fields is None else fields
    rows = batch.filter(F.coalesce("url_key", F.lit("")) != "")
    return rows.groupBy("url_key").agg(
        F.max_by(F.struct("domain", "run_id", "seen_at", *fields), F.struct("run_id", "pos")).alias("r"),
        F.min("seen_at").alias("first_at")).select("url_key", "first_at", "r.*")


def upsert(snapshot: DataFrame, batch: DataFrame, fields: list[str] | None = None, top: int | None = None) -> DataFrame:
    """The next snapshot: new keys inserted, known ones refreshed and their missing/closed marks cleared.

    Adds `changed` (a field differs or the key is new) for whoever maintains derived tables. first_seen never moves.
    New postings get the ids after the largest one: they are numbered on the batch's side, so that the snapshot is merged in
    one join. Both sides have one row per key, so the join cannot skew. `top` is the largest id where the snapshot is
    only the part of a table that holds the batch's keys.
    """
    fields = POSTING_FIELDS if fields is None else fields
    arrived = batch_postings(batch, fields)
    largest = F.coalesce(F.max("posting_id"), F.lit(0)) if top is None else F.lit(top)
    top = snapshot.agg(largest.cast("bigint").alias("__top"))
    fresh = arrived.select("url_key").join(snapshot.select("url_key"), "url_key", "left_anti")
    ids = number_rows(fresh, "url_key", "__id").join(F.broadcast(top)).select("url_key", (F.col("__id") + F.col("__top")).alias("__id"))
    new = arrived.join(ids, "url_key", "left").withColumnsRenamed({"first_at": "n_first", "domain": "n_domain", "run_id": "n_run", "seen_at": "n_seen",
                                                            **{f: f"n_{f}" for f in fields}})
    both = snapshot.withColumn("__old", F.lit(True)).join(new, "url_key", "full_outer")
    seen, old = F.col("n_run").isNotNull(), F.coalesce("__old", F.lit(False))

    def newest(field: str) -> Column:
        return F.when(seen, F.col(f"n_{field}")).otherwise(F.col(field))

    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"n_{f}"))
    return both.select(
        F.coalesce("posting_id", "__id").alias("posting_id"), "url_key", newest("domain").alias("domain"), *[newest(f).alias(f) for f in fields],
        F.coalesce("first_seen", "n_first").alias("first_seen"),
        F.when(seen, F.col("n_seen")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~seen, F.col("missing_since")).alias("missing_since"), F.when(~seen, F.col("closed_at")).alias("closed_at"),
        F.when(seen, F.col("n_run")).otherwise(F.col("last_run_id")).alias("last_run_id"),
        (seen & (~old | differs)).alias("changed"))


def link_rows(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """run_id, posting_id, is_new for a stored batch: one link per run and posting, the first row's is_new stays."""
    once = first_per_key(batch.filter(F.coalesce("url_key", F.lit("")) != ""), ["run_id", "url_key"], [F.col("pos")])
    return once.select("run_id", "url_key", "is_new").join(snapshot.select("url_key", "posting_id"), "url_key").select(
        "run_id", "posting_id", "is_new")


# ---- the two-miss rule ----

def previous_done_source(runs: DataFrame, into: str = "previous_source", bucket: int = RUN_BUCKET) -> DataFrame:
    """The base source of the company's latest earlier run that is done."""
    done = F.when(F.col("status") == "done", C.base_source(F.col("source")))
    return previous_value(runs, ["domain"], "run_id", F.floor(F.col("run_id") / bucket), done, into)


def closing_runs(runs: DataFrame, bucket: int = RUN_BUCKET) -> DataFrame:
    """Runs with `closes`: complete, done, not empty, and read from the same kind of source as the done run before."""
    same = F.col("previous_source").isNull() | (F.col("previous_source") == C.base_source(F.col("source")))
    return previous_done_source(runs, bucket=bucket).withColumn(
        "closes", F.coalesce(F.col("complete") & (F.col("status") == "done") & (F.col("jobs_count") > 0) & same, F.lit(False)))


def absence_by_run(runs: DataFrame, bucket: int = RUN_BUCKET, time_bucket: int = TIME_BUCKET_SECONDS) -> DataFrame:
    """For a posting last listed by a run: which later run finds it missing and which one closes it, and when.

    run_id, missing_run, missing_at, closed_run, closed_at. The closing run is the first closing-eligible one that
    finishes at least 24 hours after the first miss: a look-up by time, solved by sorting both kinds of moments together.
    """
    flagged = closing_runs(runs, bucket).select("domain", "run_id", "finished_at", "closes")
    moment = F.struct("run_id", "finished_at")
    after = next_value(flagged, ["domain"], "run_id", F.floor(F.col("run_id") / bucket), F.when(F.col("closes"), moment), "miss")
    micros = F.unix_micros(F.col("finished_at").cast("timestamp"))
    eligible = flagged.filter("closes")
    moments = eligible.select("domain", moment.alias("event"), (micros * 2 + 1).alias("at"), F.lit(None).cast("bigint").alias("asked_by"))
    asked = eligible.select("domain", F.lit(None).cast(moments.schema["event"].dataType).alias("event"),
                            ((micros + V.CLOSE_AFTER_HOURS * 3_600_000_000) * 2).alias("at"), F.col("run_id").alias("asked_by"))
    closing = next_value(moments.unionByName(asked), ["domain"], "at", F.floor(F.col("at") / (2 * time_bucket * 1_000_000)),
                         F.col("event"), "close").filter(F.col("asked_by").isNotNull())
    closing = closing.select(F.col("asked_by").alias("missing_run"), F.col("close.run_id").alias("closed_run"),
                             F.col("close.finished_at").alias("closed_at"))
    return (after.filter(F.col("miss").isNotNull())
            .select("run_id", F.col("miss.run_id").alias("missing_run"), F.col("miss.finished_at").alias("missing_at"))
            .join(closing, "missing_run", "left").select("run_id", "missing_run", "missing_at", "closed_run", "closed_at"))


def lifecycle(run_postings: DataFrame, runs: DataFrame, posting: str = "posting_id", bucket: int = RUN_BUCKET) -> DataFrame:
    """Every absence in the history: posting, run that listed it last before, next_run listing it again, and the marks."""
    listed = run_postings.select(posting, "run_id")
    streaks = next_value(listed, [posting], "run_id", F.floor(F.col("run_id") / bucket), F.col("run_id"), "next_run")
    marks = streaks.join(absence_by_run(runs, bucket), "run_id")
    open_end = F.col("next_run").isNull()
    closed = open_end | (F.col("closed_run") < F.col("next_run"))
    return (marks.filter(open_end | (F.col("missing_run") < F.col("next_run")))
            .select(posting, "run_id", "next_run", "missing_run", "missing_at",
                    F.when(closed, F.col("closed_run")).alias("closed_run"), F.when(closed, F.col("closed_at")).alias("closed_at")))


def with_marks(postings: DataFrame, runs: DataFrame, bucket: int = RUN_BUCKET) -> DataFrame:
    """Set missing_since and closed_at from the runs after each posting's last listing; marks already set stay."""
    marks = absence_by_run(runs, bucket).select(F.col("run_id").alias("last_run_id"), F.col("missing_at").alias("__m"),
                                                F.col("closed_at").alias("__c"))
    joined = postings.join(marks, "last_run_id", "left")
    return (joined.withColumn("missing_since", F.coalesce("missing_since", "__m"))
            .withColumn("closed_at", F.coalesce("closed_at", "__c")).select(*postings.columns))


def run_counters(run_postings: DataFrame, runs: DataFrame, absences: DataFrame) -> DataFrame:
    """Per run: postings listed, new ones, and how many it marked missing or closed."""
    listed = run_postings.groupBy("run_id").agg(F.count("*").alias("jobs"), F.count_if("is_new").alias("new"))
    missing = absences.groupBy(F.col("missing_run").alias("run_id")).agg(F.count("*").alias("missing"))
    closed = absences.filter(F.col("closed_run").isNotNull()).groupBy(F.col("closed_run").alias("run_id")).agg(
        F.count("*").alias("closed"))
    out = runs.select("run_id").join(listed, "run_id", "left").join(missing, "run_id", "left").join(closed, "run_id", "left")
    return out.na.fill(0, ["jobs", "new", "missing", "closed"])


# ---- runs and sessions ----

def mark_interrupted(runs: DataFrame, session_id: str | None, now: Column) -> DataFrame:
    """Runs of another session still 'running' can never finish."""
    stale = (F.col("status") == "running") & (F.coalesce("session_id", F.lit("")) != F.lit(session_id or ""))
    return runs.withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(stale, "interrupted").otherwise(F.col("status")))


def finish_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with the given results (run_id, status, source, jobs_count, new_count, complete, outcome, finished_at) filled in."""
    columns = [c for c in results.columns if c != "run_id"]
    renamed = results.withColumnsRenamed({c: f"__{c}" for c in columns}).withColumn("__hit", F.lit(True))
    joined = runs.join(renamed, "run_id", "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                           for c in runs.columns])


def end_session(sessions: DataFrame, session_id: str, now: Column) -> DataFrame:
    hit = (F.col("session_id") == session_id) & F.col("ended_at").isNull()
    return sessions.withColumn("ended_at", F.when(hit, now).otherwise(F.col("ended_at")))


def accepted_rows(rows: DataFrame, runs: DataFrame, limit_seconds: int | None = None) -> DataFrame:
    """Rows (run_id, arrived_at) that count: none after their run was finalised or, with a limit, after its time ran out."""
    ends = runs.select("run_id", F.col("started_at").alias("__s"), F.col("finished_at").alias("__f"))
    ok = F.col("__f").isNull() | (F.col("arrived_at") <= F.col("__f"))
    if limit_seconds is not None:
        ok = ok & (F.col("arrived_at") <= F.col("__s") + F.expr(f"INTERVAL {limit_seconds} SECONDS"))
    return rows.join(ends, "run_id").filter(ok).drop("__s", "__f")


def fingerprint(runs: DataFrame, postings: DataFrame) -> DataFrame:
    """One short text that changes when the stored history does."""
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    a = runs.agg(F.concat_ws("|", text(F.count("*")), text(F.max("run_id")), text(F.max("finished_at"))).alias("a"))
    b = postings.agg(F.concat_ws("|", text(F.count("*")), text(F.max("last_seen")), text(F.count("closed_at")),
                                 text(F.count("missing_since"))).alias("b"))
    return a.join(F.broadcast(b)).select(F.concat_ws("|", "a", "b").alias("fingerprint"))
