"""Queries over scan history. The events table is read as a scan log: a user's kind of event is a posting, a day's scan
of one of ten companies is a run that lists the postings active that day."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, retention as R, scope as SC
from ..operators.keyed import first_per_key, previous_value
from . import duck as D
from .registry import query, utc

col, lit = F.col, F.lit

KINDS = ["click", "error", "purchase", "signup", "view"]
_ID = f"(user_id * {len(KINDS)} + list_position({KINDS}, event_type) - 1)"
LOG = f"""listed AS (SELECT {_ID} AS posting_id, user_id % 10 AS d, 'd' || (user_id % 10) AS domain,
      10 * date_diff('day', DATE '2024-01-01', ts::DATE) + user_id % 10 AS run_id, min(event_id) AS pos, max(value) AS v,
      arg_max(props, event_id) AS title FROM events GROUP BY ALL),
    runs AS (SELECT run_id, domain, count(*) AS jobs_count,
      CASE WHEN run_id % 13 = 5 THEN 'stopped' WHEN run_id % 17 = 3 THEN 'failed' WHEN run_id % 23 = 20 THEN 'running' ELSE 'done' END AS status,
      CASE WHEN run_id % 29 = 7 THEN 'page' WHEN run_id % 11 = 0 THEN 'lever (by name)' WHEN run_id % 31 <> 4 THEN 'lever' END AS source,
      run_id % 7 <> 2 AS complete, TIMESTAMP '2024-01-01' + to_days((run_id // 10)::INTEGER) AS started_at,
      TIMESTAMP '2024-01-01' + to_days((run_id // 10)::INTEGER) + to_hours((1 + run_id % 5)::BIGINT) AS finished_at,
      's' || (run_id // 70) AS session_id FROM listed GROUP BY run_id, domain),
    flagged AS (SELECT *, {D.base_source('source')} AS base, last_value(CASE WHEN status = 'done' THEN {D.base_source('source')} END IGNORE NULLS)
      OVER (PARTITION BY domain ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs),
    elig AS (SELECT * FROM flagged WHERE complete AND status = 'done' AND jobs_count > 0 AND (prev IS NULL OR prev = base))"""


def listed(t):
    day = F.date_diff(col("ts").cast("date"), F.to_date(lit("2024-01-01")))
    kind = F.array_position(F.array(*[lit(k) for k in KINDS]), col("event_type"))
    return t.events.select("event_id", "props", "value", (col("user_id") * len(KINDS) + kind - 1).alias("posting_id"),
                           F.concat(lit("d"), (col("user_id") % 10).cast("string")).alias("domain"),
                           (10 * day + col("user_id") % 10).alias("run_id")) \
        .groupBy("posting_id", "domain", "run_id").agg(F.min("event_id").alias("pos"), F.max("value").alias("v"),
                                                       F.max_by("props", "event_id").alias("title"))


def runs(t):
    r = col("run_id")
    start = F.timestamp_add("DAY", F.floor(r / 10).cast("int"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    return listed(t).groupBy("run_id", "domain").agg(F.count("*").alias("jobs_count")).select(
        "run_id", "domain", "jobs_count",
        F.when(r % 13 == 5, "stopped").when(r % 17 == 3, "failed").when(r % 23 == 20, "running").otherwise("done").alias("status"),
        F.when(r % 29 == 7, "page").when(r % 11 == 0, "lever (by name)").when(r % 31 != 4, "lever").alias("source"),
        (r % 7 != 2).alias("complete"), start.alias("started_at"),
        F.timestamp_add("HOUR", (1 + r % 5).cast("int"), start).alias("finished_at"),
        F.concat(lit("s"), F.floor(r / 70).cast("string")).alias("session_id"))


@query("first_sightings", f"""
    WITH {LOG} SELECT posting_id, run_id, row_number() OVER (PARTITION BY posting_id ORDER BY run_id, pos) = 1 AS is_new FROM listed""")
def first_sightings(t):
    """WIN-5: new means the first sighting over all companies and runs."""
    return H.first_sightings(listed(t), "posting_id").select("posting_id", "run_id", "is_new")


@query("known_lookup", f"""
    WITH {LOG} SELECT posting_id, run_id, posting_id NOT IN (SELECT posting_id FROM listed WHERE run_id < 30)
      AND row_number() OVER (PARTITION BY posting_id ORDER BY pos) = 1 AS is_new FROM listed WHERE run_id >= 30""")
def known_lookup(t):
    """JOIN-5: one batch against the postings known before."""
    rows = listed(t)
    return H.mark_new(rows.filter(col("run_id") >= 30), rows.filter(col("run_id") < 30).select("posting_id").distinct(),
                      "posting_id").select("posting_id", "run_id", "is_new")


@query("previous_done_run", f"WITH {LOG} SELECT run_id, domain, prev AS previous_source FROM flagged")
def previous_done_run(t):
    """JOIN-9: the source of the company's latest earlier done run."""
    return H.previous_done_source(runs(t), bucket=40).select("run_id", "domain", "previous_source")


@query("closing_runs", f"WITH {LOG} SELECT f.run_id, e.run_id IS NOT NULL AS closes FROM flagged f LEFT JOIN elig e ON e.run_id = f.run_id")
def closing_runs(t):
    """STM-2: runs that may mark postings missing or closed."""
    return H.closing_runs(runs(t)).select("run_id", "closes")


_MARKS = """streak AS (SELECT posting_id, domain, run_id, lead(run_id) OVER (PARTITION BY posting_id ORDER BY run_id) AS next_run FROM listed),
    miss AS (SELECT s.*, min(e.run_id) AS missing_run, min(e.finished_at) AS missing_at FROM streak s JOIN elig e ON e.domain = s.domain
      AND e.run_id > s.run_id AND (s.next_run IS NULL OR e.run_id < s.next_run) GROUP BY ALL),
    marks AS (SELECT m.*, min(e.run_id) AS closed_run, min(e.finished_at) AS closed_at FROM miss m LEFT JOIN elig e ON e.domain = m.domain
      AND e.run_id > m.run_id AND (m.next_run IS NULL OR e.run_id < m.next_run) AND e.finished_at >= m.missing_at + INTERVAL 24 HOUR GROUP BY ALL)"""


@query("posting_lifecycle", f"WITH {LOG}, {_MARKS} SELECT posting_id, run_id, next_run, missing_run, missing_at, closed_run, closed_at FROM marks")
def posting_lifecycle(t):
    """WIN-6 / JOIN-12 / STM-2 (batch): every absence, when it was noticed and when it closed the posting."""
    return H.lifecycle(listed(t), runs(t)).select("posting_id", "run_id", "next_run", "missing_run", "missing_at", "closed_run", "closed_at")


@query("posting_status", f"""
    WITH {LOG}, {_MARKS} SELECT l.posting_id, l.last_run_id, m.missing_at AS missing_since, m.closed_at,
      CASE WHEN m.closed_at IS NOT NULL THEN 'closed' WHEN m.missing_at IS NOT NULL THEN 'missing' ELSE 'open' END AS status
    FROM (SELECT posting_id, max(run_id) AS last_run_id FROM listed GROUP BY 1) l LEFT JOIN marks m ON m.posting_id = l.posting_id AND m.run_id = l.last_run_id""")
def posting_status(t):
    """CLS-14 / STM-2: where every posting stands now."""
    return _snapshot(t).select("posting_id", "last_run_id", "missing_since", "closed_at").withColumn(
        "status", SC.posting_status(col("missing_since"), col("closed_at")))


def _snapshot(t):
    rows = listed(t)
    last = rows.groupBy("posting_id").agg(F.max("run_id").alias("last_run_id"), F.max_by("domain", "run_id").alias("domain"),
                                          F.max_by("title", "run_id").alias("title"))
    empty = lit(None).cast("timestamp_ntz")
    return H.with_marks(last.withColumn("missing_since", empty).withColumn("closed_at", empty), runs(t))


@query("run_counters", f"""
    WITH {LOG}, {_MARKS}, n AS (SELECT run_id, count(*) FILTER (WHERE k = 1) AS new FROM (SELECT run_id, row_number() OVER (PARTITION BY posting_id ORDER BY run_id) AS k FROM listed) GROUP BY 1)
    SELECT r.run_id, r.jobs_count::BIGINT AS jobs, n.new::BIGINT AS new, (SELECT count(*) FROM marks m WHERE m.missing_run = r.run_id)::BIGINT AS missing,
      (SELECT count(*) FROM marks m WHERE m.closed_run = r.run_id)::BIGINT AS closed FROM runs r JOIN n USING (run_id)""")
def run_counters(t):
    """AGG-7: listed, new, missing and closed per run."""
    links = H.first_sightings(listed(t), "posting_id")
    return H.run_counters(links, runs(t), H.lifecycle(listed(t), runs(t)))


_UPSERT = f"""{LOG}, old AS (SELECT posting_id AS url_key, max(run_id) AS last_run_id, arg_max(domain, run_id) AS domain, arg_max(title, run_id) AS title,
      TIMESTAMP '2024-01-01' + to_days((min(run_id) // 10)::INTEGER) AS first_seen, TIMESTAMP '2024-01-01' + to_days((max(run_id) // 10)::INTEGER) AS last_seen
      FROM listed WHERE run_id < 200 GROUP BY 1),
    new AS (SELECT posting_id AS url_key, max(run_id) AS last_run_id, arg_max(domain, run_id) AS domain, arg_max(title, run_id) AS title,
      TIMESTAMP '2024-01-01' + to_days((max(run_id) // 10)::INTEGER) AS seen, TIMESTAMP '2024-01-01' + to_days((min(run_id) // 10)::INTEGER) AS seen_first
      FROM listed WHERE run_id >= 200 GROUP BY 1)"""


@query("posting_upsert", f"""
    WITH {_UPSERT} SELECT coalesce(n.url_key, o.url_key)::VARCHAR AS url_key, coalesce(n.domain, o.domain) AS domain, coalesce(n.title, o.title) AS title,
      coalesce(o.first_seen, n.seen_first) AS first_seen, coalesce(n.seen, o.last_seen) AS last_seen,
      CASE WHEN n.url_key IS NULL THEN o.last_seen END AS missing_since, coalesce(n.last_run_id, o.last_run_id) AS last_run_id,
      n.url_key IS NOT NULL AND (o.url_key IS NULL OR o.title IS DISTINCT FROM n.title) AS changed
    FROM old o FULL JOIN new n ON n.url_key = o.url_key""")
def posting_upsert(t):
    """JOIN-7 / SNK-8 / AGG of changes: the snapshot after a batch."""
    snapshot, batch = _snapshot_and_batch(t)
    return H.upsert(snapshot, batch, ["title"]).select("url_key", "domain", "title", "first_seen", "last_seen", "missing_since",
                                                       "last_run_id", "changed")


def _snapshot_and_batch(t):
    seen = F.timestamp_add("DAY", F.floor(col("run_id") / 10).cast("int"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    rows = listed(t).withColumn("seen_at", seen).withColumn("url_key", col("posting_id").cast("string"))
    old = rows.filter(col("run_id") < 200).groupBy("url_key").agg(
        F.max_by(F.struct("domain", "title", "run_id"), "run_id").alias("r"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"))
    snapshot = H.number_rows(old, "url_key", "posting_id").select(
        "posting_id", "url_key", "r.domain", "r.title", "first_seen", "last_seen", col("last_seen").alias("missing_since"),
        lit(None).cast("timestamp_ntz").alias("closed_at"), col("r.run_id").alias("last_run_id"))
    return snapshot, rows.filter(col("run_id") >= 200).drop("posting_id")


@query("posting_ids", f"""
    WITH {_UPSERT} SELECT count(*)::BIGINT AS postings, count(*)::BIGINT AS ids, 1::BIGINT AS lowest, count(*)::BIGINT AS highest
    FROM old o FULL JOIN new n ON n.url_key = o.url_key""")
def posting_ids(t):
    """JOIN-7: ids stay unique and dense over an upsert."""
    snapshot, batch = _snapshot_and_batch(t)
    return H.upsert(snapshot, batch, ["title"]).agg(F.count("*").alias("postings"), F.count_distinct("posting_id").alias("ids"),
                                                    F.min("posting_id").alias("lowest"), F.max("posting_id").alias("highest"))


@query("batch_links", f"""
    WITH {LOG} SELECT run_id, posting_id::VARCHAR AS url_key, posting_id % 3 = 0 AS is_new FROM listed WHERE run_id >= 200""")
def batch_links(t):
    """JOIN-7: one link per run and posting."""
    snapshot, batch = _snapshot_and_batch(t)
    merged = H.upsert(snapshot, batch, ["title"])
    marked = batch.withColumn("is_new", col("url_key").cast("bigint") % 3 == 0)
    again = marked.unionByName(marked.withColumn("pos", col("pos") + 1000000).withColumn("is_new", lit(True)))
    return H.link_rows(again, merged).join(merged.select("posting_id", "url_key"), "posting_id").select("run_id", "url_key", "is_new")


# ---- scopes ----

_LATEST = "latest AS (SELECT max(run_id) AS run_id FROM runs WHERE status IN ('running', 'done', 'stopped') {s} GROUP BY domain)"


@query("scope_current", f"WITH {LOG}, {_LATEST.format(s='')} SELECT posting_id, run_id FROM listed WHERE run_id IN (SELECT run_id FROM latest)")
def scope_current(t):
    """SCP-1 / JOIN-1 / JOIN-3: what the newest scan of each company saw."""
    return SC.current(_snapshot(t).drop("domain"), listed(t).select("posting_id", "run_id"), runs(t)).select("posting_id", "run_id")


@query("scope_session", f"""
    WITH {LOG}, {_LATEST.format(s="AND session_id = 's2'")} SELECT posting_id, run_id FROM listed WHERE run_id IN (SELECT run_id FROM latest)""")
def scope_session(t):
    """SCP-5: the newest scan within one session."""
    return SC.current(_snapshot(t).drop("domain"), listed(t).select("posting_id", "run_id"), runs(t), "s2").select("posting_id", "run_id")


@query("scope_run", f"WITH {LOG} SELECT posting_id, run_id, title FROM listed WHERE run_id = 123")
def scope_run(t):
    """SCP-2: one run."""
    return SC.of_run(listed(t).select("posting_id", "title", "run_id").withColumnRenamed("run_id", "r").filter(col("r") == 123),
                     listed(t).select("posting_id", "run_id"), 123).select("posting_id", "run_id", "title")


@query("matches_per_run", f"""
    WITH {LOG}, last AS (SELECT posting_id, arg_max(title, run_id) AS title FROM listed GROUP BY 1)
    SELECT r.run_id, count(l.posting_id)::BIGINT AS matches FROM runs r LEFT JOIN (SELECT listed.* FROM listed JOIN last USING (posting_id)
      WHERE contains(last.title, '1')) l ON l.run_id = r.run_id GROUP BY 1""")
def matches_per_run(t):
    """SCP-3 / AGG-4: matching postings of every run."""
    rows = listed(t)
    last = rows.groupBy("posting_id").agg(F.max_by("title", "run_id").alias("title"))
    every = SC.of_every_run(last.filter(F.contains("title", lit("1"))), rows.select("posting_id", "run_id"))
    return SC.matches_per_run(every, runs(t))


_GONE = f"""{LOG}, {_MARKS}, last AS (SELECT posting_id, max(run_id) AS run_id, arg_max(domain, run_id) AS domain FROM listed GROUP BY 1),
    gone AS (SELECT l.posting_id, l.run_id, l.domain, m.missing_at, m.closed_at FROM last l JOIN marks m ON m.posting_id = l.posting_id AND m.run_id = l.run_id)"""


@query("scope_missing", f"WITH {_GONE} SELECT posting_id, run_id, posting_id % 2 = 0 AS is_new, 'missing' AS status FROM gone WHERE closed_at IS NULL")
def scope_missing(t):
    """SCP-4 / JOIN-2 / PRJ-2: postings gone missing, with their last run's link."""
    links = listed(t).select("posting_id", "run_id", (col("posting_id") % 2 == 0).alias("is_new"))
    return SC.query_columns(SC.gone(_snapshot(t), links, "missing")).select("posting_id", "run_id", "is_new", "status")


@query("scope_closed_session", f"WITH {_GONE} SELECT posting_id, run_id, 'closed' AS status FROM gone WHERE closed_at IS NOT NULL AND domain IN (SELECT domain FROM runs WHERE session_id = 's1')")
def scope_closed_session(t):
    """SCP-4 / SCP-5: closed postings of companies scanned in a session."""
    links = listed(t).select("posting_id", "run_id", lit(False).alias("is_new"))
    return SC.query_columns(SC.gone(_snapshot(t), links, "closed", runs(t), "s1")).select("posting_id", "run_id", "status")


@query("run_history", f"WITH {LOG} SELECT run_id, domain, status, jobs_count::BIGINT AS jobs_count FROM runs")
def run_history(t):
    """SRT-2: runs, newest first."""
    return runs(t).orderBy(F.desc("run_id")).select("run_id", "domain", "status", "jobs_count")


# ---- streaming rules in batch ----

@query("late_rows", """
    SELECT event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s FROM events) WHERE ts <= s + INTERVAL 240 HOUR""")
def late_rows(t):
    """STM-3: nothing is accepted after a run was finalised."""
    runs_ = t.events.groupBy(col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at")).withColumn(
        "finished_at", col("started_at") + F.expr("INTERVAL 240 HOURS"))
    rows = t.events.select("event_id", col("user_id").alias("run_id"), col("ts").alias("arrived_at"))
    return H.accepted_rows(rows, runs_).select("event_id")


@query("time_limited_rows", """
    SELECT user_id, count(*)::BIGINT AS kept, 'timed_out' AS outcome FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s FROM events)
    WHERE ts <= s + INTERVAL 180 HOUR GROUP BY user_id""")
def time_limited_rows(t):
    """STM-4: rows up to the time limit are kept."""
    runs_ = t.events.groupBy(col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at")).withColumn(
        "finished_at", lit(None).cast("timestamp_ntz"))
    rows = t.events.select(col("user_id").alias("run_id"), col("ts").alias("arrived_at"))
    kept = H.accepted_rows(rows, runs_, limit_seconds=180 * 3600)
    return kept.groupBy(col("run_id").alias("user_id")).agg(F.count("*").alias("kept")).withColumn("outcome", lit("timed_out"))


@query("feed_since", "SELECT event_id, event_type FROM events WHERE event_id >= 500")
def feed_since(t):
    """STM-5: everything from a cursor on; the cursor reaches the scan."""
    return R.feed_since(t.events, 500).select("event_id", "event_type")


@query("feed_trimmed", """
    WITH e AS (SELECT count(*) AS n FROM events) SELECT event_id FROM events, e
    WHERE event_id >= CASE WHEN n <= 300 THEN 0 ELSE 181 * ((n - 301) // 181 + 1) END""")
def feed_trimmed(t):
    """STM-5: what is left after trimming the feed to its newest entries."""
    return R.trim_feed(t.events, trim_at=300, keep=120).select("event_id")


@query("interrupted_runs", f"""
    WITH {LOG} SELECT run_id, CASE WHEN status = 'running' AND session_id <> 's2' THEN 'interrupted' ELSE status END AS status,
      CASE WHEN status = 'running' AND session_id <> 's2' THEN TIMESTAMP '2024-02-01' ELSE finished_at END AS finished_at FROM runs""")
def interrupted_runs(t):
    """STM-7."""
    return H.mark_interrupted(runs(t), "s2", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("run_id", "status", "finished_at")


@query("data_fingerprint", f"""
    WITH {_GONE} SELECT (SELECT count(*) || '|' || max(run_id) || '|' || max(finished_at) FROM runs) || '|' ||
      (SELECT count(*) || '|' || max(run_id) FROM last) || '|' || (SELECT count(closed_at) || '|' || count(*) FROM gone) AS fingerprint""")
def data_fingerprint(t):
    """AGG-9."""
    return H.fingerprint(runs(t), _snapshot(t).withColumn("last_seen", col("last_run_id")))


# ---- retention ----

_PRUNE = f"""{_GONE}, old AS (SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY domain ORDER BY run_id DESC) AS n FROM runs WHERE status <> 'running') WHERE n > 20),
    dead AS (SELECT posting_id FROM gone WHERE closed_at < TIMESTAMP '2024-02-01' - INTERVAL 6 DAY)"""


def _pruned(t):
    links = listed(t).select("run_id", "posting_id")
    state = _snapshot(t)
    return runs(t), state, links, R.prune(runs(t), state, links, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), keep_runs=20, closed_days=6)


@query("pruned_runs", f"WITH {_PRUNE} SELECT run_id, status FROM runs WHERE run_id NOT IN (SELECT run_id FROM old)")
def pruned_runs(t):
    """MNT-1 / WIN-1: the newest runs per company stay, running ones always."""
    return _pruned(t)[3][0].select("run_id", "status")


@query("pruned_links", f"WITH {_PRUNE} SELECT run_id, posting_id FROM listed WHERE run_id NOT IN (SELECT run_id FROM old) AND posting_id NOT IN (SELECT posting_id FROM dead)")
def pruned_links(t):
    """MNT-1 / JOIN-4: links of dropped runs and postings go with them."""
    return _pruned(t)[3][2]


@query("prune_counts", f"""
    WITH {_PRUNE} SELECT 'runs' AS "table", count(*)::BIGINT AS removed FROM old UNION ALL SELECT 'postings', count(*) FROM dead UNION ALL
    SELECT 'run_postings', count(*) FROM listed WHERE run_id IN (SELECT run_id FROM old) OR posting_id IN (SELECT posting_id FROM dead)""")
def prune_counts(t):
    """AGG-14: what a retention run removes."""
    r, p, links, kept = _pruned(t)
    return R.prune_counts(r, p, links, kept)


@query("expired_pages", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR")
def expired_pages(t):
    """MNT-4: stored pages young enough to keep."""
    pages = t.events.select("event_id", col("ts").alias("fetched_at"))
    return R.expire_pages(pages, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), 7 * 86400).select("event_id")


@query("remote_backfill", """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'onsite' END, CASE WHEN o_custkey % 2 = 1 THEN 'remote' END) AS workplace FROM orders""")
def remote_backfill(t):
    """MNT-3."""
    o = t.orders.select("o_orderkey", F.when(col("o_orderstatus") == "F", "onsite").alias("workplace"), (col("o_custkey") % 2).alias("remote"))
    return R.backfill_workplace(o).select("o_orderkey", "workplace")


_OLD = """jobs AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_orderkey AS run_id, 'k' || l_partkey AS url_key, l_linenumber % 2 AS is_new,
      l_returnflag AS title FROM lineitem),
    r AS (SELECT o_orderkey AS run_id, 'c' || o_custkey AS domain, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at FROM orders),
    seen AS (SELECT 'k' || p_partkey AS url_key, TIMESTAMP '1990-01-01' AS first_seen FROM part WHERE p_size > 25)"""


def _old_layout(t):
    """The line items as the old per-run job table; ids follow the order given."""
    li = t.lineitem
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    jobs = li.select(rank.alias("id"), col("l_orderkey").alias("run_id"), F.concat(lit("k"), col("l_partkey").cast("string")).alias("url_key"),
                     (col("l_linenumber") % 2).alias("is_new"), col("l_returnflag").alias("title"))
    old_runs = t.orders.select(col("o_orderkey").alias("run_id"), F.concat(lit("c"), col("o_custkey").cast("string")).alias("domain"),
                               col("o_orderdate").alias("started_at"),
                               F.when(col("o_orderstatus") == "F", col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    seen = t.part.filter(col("p_size") > 25).select(F.concat(lit("k"), col("p_partkey").cast("string")).alias("url_key"),
                                                    F.expr("TIMESTAMP_NTZ '1990-01-01 00:00:00'").alias("first_seen"))
    return R.postings_from_jobs(jobs, old_runs, seen, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), ["title"])


@query("migrated_postings", f"""
    WITH {_OLD}, newest AS (SELECT DISTINCT ON (url_key) * FROM jobs ORDER BY url_key, id DESC)
    SELECT j.url_key, r.domain, j.title, coalesce(s.first_seen, (SELECT min(r0.started_at) FROM jobs j0 JOIN r r0 ON r0.run_id = j0.run_id WHERE j0.url_key = j.url_key)) AS first_seen,
      coalesce(r.finished_at, r.started_at) AS last_seen, j.run_id AS last_run_id FROM newest j JOIN r ON r.run_id = j.run_id LEFT JOIN seen s ON s.url_key = j.url_key""")
def migrated_postings(t):
    """MNT-2 / WIN-2 / JOIN-10: the old per-run layout as one row per posting."""
    return _old_layout(t)[0].select("url_key", "domain", "title", "first_seen", "last_seen", "last_run_id")


@query("migrated_links", f"""
    WITH {_OLD} SELECT run_id, url_key, max(is_new)::INTEGER AS is_new FROM jobs WHERE url_key IN (SELECT url_key FROM (SELECT DISTINCT ON (url_key) url_key, run_id FROM jobs ORDER BY url_key, id DESC)
      JOIN r USING (run_id)) GROUP BY run_id, url_key""")
def migrated_links(t):
    """MNT-2: links, new if any copy was."""
    postings, links = _old_layout(t)
    return links.join(postings.select("posting_id", "url_key"), "posting_id").select("run_id", "url_key", "is_new")
