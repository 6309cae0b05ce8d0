import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rolecall.operators import history as H

START = datetime(2024, 1, 1)


def scan_log(seed):
    r = random.Random(seed)
    runs, links = [], []
    for run_id in range(1, 90):
        domain = "big" if r.random() < 0.6 else r.choice(["x", "y"])
        finished = START + timedelta(hours=7 * run_id)
        listed = [p for p in range(12) if r.random() < 0.45]
        status = r.choice(["done"] * 6 + ["stopped", "failed"])
        source = r.choice(["lever"] * 6 + ["lever (by name)", "page", None])
        runs.append((run_id, domain, source, status, r.random() < 0.85, len(listed), finished))
        links += [(run_id, f"{domain}-{p}") for p in listed]
    return runs, links


def step_by_step(runs, links):
    """The rule as it happens: one run after the other."""
    marks, last, state, sources = {}, {}, {}, {}
    base = lambda s: (s or "").replace(" (by name)", "")
    for run_id, domain, source, status, complete, jobs, now in runs:
        for r, p in links:
            if r == run_id:
                state[p], last[p] = [None, None], run_id
        previous = sources.get(domain)
        if complete and status == "done" and jobs and (previous is None or previous == base(source)):
            for p, s in state.items():
                if p.split("-")[0] != domain or last[p] == run_id or s[1]:
                    continue
                if s[0] is None:
                    s[0] = now
                    marks[(p, last[p])] = [now, None]
                elif s[0] <= now - timedelta(hours=24):
                    s[1] = now
                    marks[(p, last[p])][1] = now
        if status == "done":
            sources[domain] = base(source)
    return marks, state


def frames(spark, runs, links):
    r = spark.createDataFrame(runs, "run_id BIGINT, domain STRING, source STRING, status STRING, complete BOOLEAN, jobs_count BIGINT, "
                                    "finished_at TIMESTAMP_NTZ")
    return r, spark.createDataFrame(links, "run_id BIGINT, posting_id STRING")


def test_lifecycle_equals_one_run_at_a_time(spark):
    runs, links = scan_log(3)
    want, state = step_by_step(runs, links)
    r, l = frames(spark, runs, links)
    got = {(x.posting_id, x.run_id): [x.missing_at, x.closed_at] for x in H.lifecycle(l, r, bucket=10).collect()}
    assert got == want and any(c for _, c in want.values())
    last = l.groupBy("posting_id").agg(F.max("run_id").alias("last_run_id"))
    empty = F.lit(None).cast("timestamp_ntz")
    now = H.with_marks(last.withColumn("missing_since", empty).withColumn("closed_at", empty), r).collect()
    assert {x.posting_id: [x.missing_since, x.closed_at] for x in now} == state


def test_upsert_batches_equal_one_batch(spark):
    r = random.Random(5)
    rows = [(run, pos, f"k{r.randrange(15)}", f"d{run % 2}", START + timedelta(days=run), f"t{r.randrange(3)}")
            for run in range(1, 7) for pos in range(8)]
    ddl = "run_id BIGINT, pos BIGINT, url_key STRING, domain STRING, seen_at TIMESTAMP_NTZ, title STRING"
    empty = spark.createDataFrame([], "posting_id BIGINT, url_key STRING, domain STRING, title STRING, first_seen TIMESTAMP_NTZ, "
                                      "last_seen TIMESTAMP_NTZ, missing_since TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ, last_run_id BIGINT")
    batch = spark.createDataFrame(rows, ddl)
    once = H.upsert(empty, batch, ["title"])
    half = H.upsert(empty, batch.filter("run_id <= 3"), ["title"]).drop("changed")
    twice = H.upsert(half, batch.filter("run_id > 3"), ["title"])
    columns = ["url_key", "domain", "title", "first_seen", "last_seen", "last_run_id"]
    assert sorted(map(tuple, once.select(columns).collect())) == sorted(map(tuple, twice.select(columns).collect()))
    ids = [x.posting_id for x in twice.collect()]
    assert len(set(ids)) == len(ids) and min(ids) == 1


def test_new_once_per_batch(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None)], "pos INT, url_key STRING")
    known = spark.createDataFrame([("b",)], "url_key STRING")
    assert {x.pos: x.is_new for x in H.mark_new(batch, known).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
