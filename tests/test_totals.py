"""Live totals by signed changes against a recount of the posting table, with batches committed again and folded."""
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolecall.streaming.table import PostingTable
from rolecall.streaming.totals import LiveTotals

SCHEMA = ("posting_id BIGINT, url_key STRING, domain STRING, title STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, "
          "missing_since TIMESTAMP, closed_at TIMESTAMP, last_run_id BIGINT")
def matching():
    return F.col("title").startswith("a")


# run, company, listed (key, title)
BATCHES = [[(1, "x", [("k1", "a"), ("k2", "b"), ("k3", None), (None, "a"), ("", "a")]), (2, "y", [("k4", "a"), ("k4", "a")])],
           [(3, "x", [("k1", "b"), ("k2", "a")]), (4, "y", [("k3", "a"), ("k4", "a")])],      # k3 moves to y
           [],
           [(5, "x", [("k5", "a")]), (6, None, [("k6", "a")])],
           [(7, "y", [("k4", "c")])],
           [(8, "x", [("k5", "a"), ("k4", "a")])]]                                           # k4 moves to x, y keeps k3


def rows(spark, batch):
    flat = [(run, pos, domain, key, datetime(2024, 1, run), title) for run, domain, listed in batch for pos, (key, title) in enumerate(listed)]
    return spark.createDataFrame(flat, "run_id BIGINT, pos BIGINT, domain STRING, url_key STRING, seen_at TIMESTAMP, title STRING")


def runs(spark, upto):
    done = [(run, domain, len(listed), "done", "lever", True, datetime(2024, 1, run), datetime(2024, 1, run) + timedelta(hours=1), "s")
            for batch in BATCHES[:upto] for run, domain, listed in batch]
    return spark.createDataFrame(done, "run_id BIGINT, domain STRING, jobs_count BIGINT, status STRING, source STRING, complete BOOLEAN, "
                                       "started_at TIMESTAMP, finished_at TIMESTAMP, session_id STRING")


def recount(history):
    hit, is_open = F.coalesce(matching(), F.lit(False)), F.col("closed_at").isNull()
    return history.groupBy("domain").agg(F.count_if(hit).alias("matching"), F.count("*").alias("total"),
                                         F.count_if(hit & is_open).alias("open_matching"), F.count_if(is_open).alias("open"))


def ordered(df):
    return sorted(map(tuple, df.select("domain", "matching", "total", "open_matching", "open").collect()), key=str)


def test_totals_equal_a_recount_after_every_batch(spark, tmp_path, every=2):
    table = PostingTable(spark, str(tmp_path / "postings"), SCHEMA, ["title"], buckets=3, most_deltas=2)
    totals = LiveTotals(spark, str(tmp_path / "totals"), matching(), every)
    table.create()
    totals.create()
    assert ordered(totals.read(runs(spark, 1))) == []
    for number, batch in enumerate(BATCHES):
        new = rows(spark, batch)
        for _ in range(2 if number in (1, 3) else 1):  # a batch run again counts once
            table.store(new, number)
            totals.commit(table.changes(new, number), number)
        known = runs(spark, number + 1)
        assert ordered(totals.read(known)) == ordered(recount(table.history(known)))
    last = {r[0]: r[1:] for r in ordered(totals.read(known))}
    assert last["x"] == (3, 4, 2, 2)  # k1 and k2 were missed by run 5 and closed by run 8
    assert last["y"] == (1, 1, 1, 1)  # k3, which run 7 missed and no later run has closed
    assert len(os.listdir(tmp_path / "totals" / "base")) <= 2 and sum(x.startswith("batch") for x in os.listdir(tmp_path / "totals" / "delta")) <= 2 * every + 2


def test_a_fold_that_was_lost_is_made_again(spark, tmp_path, monkeypatch):
    table = PostingTable(spark, str(tmp_path / "postings"), SCHEMA, ["title"], buckets=3)
    totals = LiveTotals(spark, str(tmp_path / "totals"), matching(), every=2)
    table.create()
    totals.create()
    for number, batch in enumerate(BATCHES[:4]):
        new = rows(spark, batch)
        table.store(new, number)
        if number == 3:
            with monkeypatch.context() as broken:
                def lost(sums, upto):
                    sums.limit(1).write.mode("overwrite").parquet(f"{totals.folder}/base/upto={upto}")
                    raise OSError("executor lost")
                broken.setattr(totals, "_put_base", lost)
                with pytest.raises(OSError):
                    totals.commit(table.changes(new, number), number)
            known = runs(spark, number + 1)
            assert ordered(totals.read(known)) == ordered(recount(table.history(known)))
        totals.commit(table.changes(new, number), number)
    assert ordered(totals.read(known)) == ordered(recount(table.history(known)))
