"""Queries that write and read back: exports and streaming runs over the given tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.filters import JobFilter
from ..session import shared_folder
from ..sinks import exports as X
from ..streaming import ingest as ST
from ..streaming.table import PostingTable
from ..streaming.totals import LiveTotals
from . import history as HP
from .postings import POSTINGS, gazetteer, postings
from .registry import pick, query

col, lit = F.col, F.lit


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/rolecall-{uuid.uuid4().hex}"


_STARTS = ["=", "+", "-", "@", "", "'", "x"]


@query("safe_cells", """
    SELECT p_partkey, CASE WHEN regexp_matches(n, '^[=+@\\t\\r-]') THEN '''' || n ELSE n END AS cell
    FROM (SELECT p_partkey, (['=', '+', '-', '@', '', '''', 'x'])[p_partkey % 7 + 1] || p_name AS n FROM part)""")
def safe_cells(t):
    """SNK-2: cells a spreadsheet would run as a formula get an apostrophe."""
    p = t.part.select("p_partkey", F.concat(pick(_STARTS, col("p_partkey")), "p_name").alias("cell"))
    return X.export_columns(p, ["p_partkey", "cell"])


_FIELDS = ["posting_id", "company", "title", "workplace", "country"]


@query("export_csv", f"WITH {POSTINGS} SELECT {', '.join(_FIELDS)} FROM p")
def export_csv(t):
    """SNK-1 / SNK-5: all postings as CSV, read back."""
    path = _folder(t)
    X.write_csv(postings(t), path, _FIELDS)
    return t.spark.read.option("header", True).option("escape", '"').schema(
        "posting_id BIGINT, company STRING, title STRING, workplace STRING, country STRING").csv(path)


@query("export_json", f"WITH {POSTINGS} SELECT {', '.join(_FIELDS)} FROM p")
def export_json(t):
    """SNK-3: JSON lines, read back."""
    path = _folder(t)
    X.write_json(postings(t), path, _FIELDS)
    return t.spark.read.schema("posting_id BIGINT, company STRING, title STRING, workplace STRING, country STRING").json(path)


@query("export_filtered", f"""
    WITH {POSTINGS}, m AS (SELECT * FROM p WHERE workplace = 'remote') SELECT 'Remote' AS filters, (SELECT count(*) FROM m)::BIGINT AS matching,
      (SELECT count(*) FROM p)::BIGINT AS total, posting_id FROM m""")
def export_filtered(t):
    """SNK-3: a filtered export says what it holds."""
    p = postings(t)
    rows = X.filtered_rows(p.filter(col("workplace") == "remote"), "Remote", p.count(), _FIELDS)
    return rows.select("filters", "matching", col("total").cast("bigint").alias("total"), "job.posting_id")


@query("export_companies", f"WITH {POSTINGS} SELECT domain, count(*)::BIGINT AS postings FROM p GROUP BY domain")
def export_companies(t):
    """SNK-4: one folder per company, read back."""
    path = _folder(t)
    X.write_companies(postings(t), path, _FIELDS)
    return X.read_companies(t.spark, path, _FIELDS).groupBy("domain").agg(F.count("*").alias("postings"))


@query("export_session", f"WITH {POSTINGS} SELECT posting_id, title FROM p WHERE is_new")
def export_session(t):
    """SNK-6: a session's matching postings; nothing is written when there are none."""
    path = _folder(t)
    X.write_session(postings(t).filter("is_new"), path, filtered=True, fields=["posting_id", "title"])
    return t.spark.read.option("header", True).schema("posting_id BIGINT, title STRING").csv(path)


@query("export_manifest", f"WITH {POSTINGS} SELECT count(*)::BIGINT AS rows, true AS this_session FROM p")
def export_manifest(t):
    """SNK-7: files written, their rows and whether this session wrote them."""
    path = _folder(t)
    X.write_csv(postings(t), path, _FIELDS)
    files = X.manifest(t.spark, path, F.expr("TIMESTAMP '2000-01-01 00:00:00'"))
    return files.agg(F.sum("rows").alias("rows"), F.bool_and("this_session").alias("this_session"))


# ---- streaming ----

def _deliver(df, part, folder, start):
    """Rows as they land: one delivery for each value 0, 1, 2 of `part`, in any number of files.

    The stream is started again after each delivery, from its checkpoint, and takes what is new.
    """
    for n in range(3):
        df.filter(part == n).write.mode("append").parquet(folder)
        start(df.sparkSession.readStream.schema(df.schema).parquet(folder)).awaitTermination()


def _third():
    days = F.date_diff(col("ts").cast("date"), F.to_date(lit("2024-01-01")))
    return F.least(F.floor(days / 10), lit(2))


def _rows(events, key=None):
    kind = F.array_position(F.array(*[lit(k) for k in HP.KINDS]), col("event_type"))
    day = F.date_diff(col("ts").cast("date"), F.to_date(lit("2024-01-01")))
    own = (col("user_id") * len(HP.KINDS) + kind - 1).cast("string")
    return events.select((own if key is None else key).alias("url_key"),
                         F.concat(lit("d"), (col("user_id") % 10).cast("string")).alias("domain"),
                         (10 * day + col("user_id") % 10).cast("bigint").alias("run_id"), col("event_id").alias("pos"),
                         col("props").alias("title"), col("ts").alias("seen_at"))


_EMPTY = ("posting_id BIGINT, url_key STRING, domain STRING, title STRING, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, "
          "missing_since TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ, last_run_id BIGINT")


def _ingested(t):
    folder = _folder(t)
    table = PostingTable(t.spark, f"{folder}/postings", _EMPTY, ["title"], buckets=8)
    table.create()
    _deliver(t.events, _third(), f"{folder}/landed", lambda landed: ST.ingest(
        _rows(landed), table, f"{folder}/links", f"{folder}/checkpoint", available_now=True))
    return folder, table


@query("stream_ingest", """
    SELECT (user_id * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::VARCHAR AS url_key, 'd' || (user_id % 10) AS domain,
      arg_max(props, event_id) AS title, arg_max(ts, event_id) AS last_seen, count(DISTINCT ts::DATE)::BIGINT AS runs FROM events GROUP BY 1, 2""")
def stream_ingest(t):
    """STM-1 / SNK-8: landed rows streamed into the history; the final version and its links."""
    folder, table = _ingested(t)
    links = t.spark.read.parquet(f"{folder}/links").groupBy("posting_id").agg(F.count("*").alias("runs"))
    return table.read().join(links, "posting_id").select("url_key", "domain", "title", "last_seen", "runs")


_LIFECYCLE = f"""
    WITH {HP.LOG}, {HP._MARKS} SELECT l.posting_id::VARCHAR AS url_key, m.missing_at AS missing_since, m.closed_at FROM (SELECT posting_id, max(run_id) AS run_id FROM listed GROUP BY 1) l
    LEFT JOIN marks m ON m.posting_id = l.posting_id AND m.run_id = l.run_id"""


@query("stream_history", _LIFECYCLE)
def stream_history(t):
    """STM-1 / STM-2: rows streamed into the bucketed table, its marks from the finished runs."""
    _, table = _ingested(t)
    return table.history(HP.runs(t)).select("url_key", "missing_since", "closed_at")


@query("stream_lifecycle", _LIFECYCLE)
def stream_lifecycle(t):
    """STM-2: finished runs streamed in mark postings missing and closed, as the batch replay does."""
    folder, table = _ingested(t)
    runs = HP.runs(t)
    tables = ST.Snapshots(t.spark, f"{folder}/runs")
    tables.write(runs.limit(0), 0)
    marked = ST.Snapshots(t.spark, f"{folder}/marked")
    marked.write(table.read(), 0)
    _deliver(runs, F.least(F.floor(col("run_id") / 100), lit(2)), f"{folder}/finished", lambda landed: ST.close_missing(
        landed, tables, marked, f"{folder}/checkpoint-runs", available_now=True))
    return marked.read(marked.latest()).select("url_key", "missing_since", "closed_at")


@query("stream_counts", """
    SELECT 'u' || (user_id % 10) AS domain, count(*) FILTER (WHERE event_type IN ('click', 'view'))::BIGINT AS matching, count(*)::BIGINT AS total FROM events GROUP BY 1""")
def stream_counts(t):
    """STM-6: live counts per company while rows stream in."""
    folder, names = _folder(t), gazetteer(t.spark)

    def count(events):
        rows = events.select(F.concat(lit("u"), (col("user_id") % 10).cast("string")).alias("domain"), col("event_type").alias("source"))
        return ST.write_counts(ST.live_counts(rows, JobFilter(source=["click", "view"]), names), f"{folder}/counts", f"{folder}/checkpoint", available_now=True)

    _deliver(t.events, col("event_id") % 3, f"{folder}/landed", count)
    return ST.read_counts(t.spark, f"{folder}/counts")


@query("stream_totals", f"""
    WITH {HP.LOG}, last AS (SELECT k, max_by({{'domain': d, 'run_id': r, 'title': props}}, r * 10000000000 + event_id) AS x FROM (
      SELECT (user_id // 2) * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS k, 'd' || (user_id % 10) AS d, props, event_id,
        10 * date_diff('day', DATE '2024-01-01', ts::DATE) + user_id % 10 AS r FROM events) GROUP BY 1),
    l AS (SELECT k, x.domain AS domain, x.run_id AS run_id, x.title LIKE '%7%' AS hit FROM last),
    m AS (SELECT l.*, min(e.run_id) AS missing_run, min(e.finished_at) AS missing_at FROM l LEFT JOIN elig e ON e.domain = l.domain AND e.run_id > l.run_id GROUP BY ALL),
    c AS (SELECT m.*, min(e.finished_at) AS closed_at FROM m LEFT JOIN elig e ON e.domain = m.domain AND e.run_id > m.missing_run
      AND e.finished_at >= m.missing_at + INTERVAL 24 HOUR GROUP BY ALL)
    SELECT domain, count(*) FILTER (WHERE hit)::BIGINT AS matching, count(*)::BIGINT AS total, count(*) FILTER (WHERE hit AND closed_at IS NULL)::BIGINT AS open_matching,
      count(*) FILTER (WHERE closed_at IS NULL)::BIGINT AS open FROM c GROUP BY 1""")
def stream_totals(t):
    """STM-6: counts per company while postings are listed again, change, move to another company and are closed."""
    folder = _folder(t)
    table = PostingTable(t.spark, f"{folder}/postings", _EMPTY, ["title"], buckets=8)
    totals = LiveTotals(t.spark, f"{folder}/totals", col("title").contains("7"), every=2)
    table.create()
    totals.create()
    kind = F.array_position(F.array(*[lit(k) for k in HP.KINDS]), col("event_type"))
    shared = (F.floor(col("user_id") / 2) * len(HP.KINDS) + kind).cast("string")  # two companies list the same address in turn
    rows = t.events.withColumn("shared", shared)
    _deliver(rows, _third(), f"{folder}/landed", lambda landed: ST.ingest(
        _rows(landed, col("shared")), table, f"{folder}/links", f"{folder}/checkpoint", available_now=True, totals=totals))
    return totals.read(HP.runs(t))


@query("stream_without_repeats", """
    SELECT user_id, event_type, count(*)::BIGINT AS events FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2""")
def stream_without_repeats(t):
    """STM-1: repeats of a streaming run are dropped before they are stored."""
    folder = _folder(t)

    def once(events):
        twice = events.select("user_id", "event_type", "event_id", col("ts").cast("timestamp").alias("ts")).withColumn("copy", F.explode(F.array(lit(1), lit(2))))
        rows = ST.without_repeats(twice, "ts", ["event_id"], "1 day").drop("copy")
        return (rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(availableNow=True).start())

    _deliver(t.events, _third(), f"{folder}/landed", once)
    return t.spark.read.parquet(f"{folder}/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("events"))


# ---- sessions and runs ----

@query("run_bookkeeping", f"""
    WITH {HP.LOG} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN run_id % 3 = 0 THEN 'found' END AS outcome FROM runs""")
def run_bookkeeping(t):
    """MNT-6: results of finished runs written into the runs table."""
    runs = HP.runs(t).withColumn("outcome", lit(None).cast("string"))
    results = runs.filter(col("run_id") % 3 == 0).select("run_id", lit("done").alias("status"), lit("found").alias("outcome"))
    return H.finish_runs(runs, results).select("run_id", "status", "outcome")


@query("session_bookkeeping", f"""
    WITH {HP.LOG} SELECT session_id, min(started_at) AS started_at, CASE WHEN session_id = 's1' THEN TIMESTAMP '2024-02-01' END AS ended_at FROM runs GROUP BY 1""")
def session_bookkeeping(t):
    """MNT-6: a session opened with its first run and closed."""
    sessions = HP.runs(t).groupBy("session_id").agg(F.min("started_at").alias("started_at")).withColumn("ended_at", lit(None).cast("timestamp_ntz"))
    return H.end_session(sessions, "s1", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
