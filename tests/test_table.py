"""The bucketed posting table against the whole-table upsert, with batches run again, lost and late."""
import os

import pytest
from pyspark.sql import functions as F

from rolecall.operators import history as H
from rolecall.streaming.table import PostingTable

SCHEMA = ("posting_id BIGINT, url_key STRING, domain STRING, title STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, "
          "missing_since TIMESTAMP, closed_at TIMESTAMP, last_run_id BIGINT")
BATCH = "run_id BIGINT, pos BIGINT, domain STRING, url_key STRING, seen_at TIMESTAMP, title STRING"


def batch(spark, run, keys):
    rows = spark.createDataFrame([(run, i, "d", k, f"t{run}" if i % 2 else None) for i, k in enumerate(keys)], "run_id BIGINT, pos BIGINT, domain STRING, url_key STRING, title STRING")
    return rows.withColumn("seen_at", F.timestamp_seconds(F.col("run_id") * 86_400 + F.col("pos"))).select("run_id", "pos", "domain", "url_key", "seen_at", "title")


BATCHES = [(1, [f"k{i}" for i in range(60)] + [None, "", "k3", "k3"]), (2, [f"k{i}" for i in range(40, 45)]), (3, []), (4, ["k2"]),
           (5, [f"k{i}" for i in range(50, 90)]), (6, ["new", "k89", "new"]), (7, ["k1"]), (8, ["k1", "k5"])]


def table(spark, folder, **options):
    return PostingTable(spark, folder, SCHEMA, ["title"], buckets=4, **options)


def rows(df):
    return sorted(map(tuple, df.select("posting_id", "url_key", "domain", "title", "first_seen", "last_seen", "last_run_id").collect()))


def folders(folder):
    return sorted(os.path.relpath(d, folder) for d, _, names in os.walk(folder) if any(n.startswith("part-") for n in names))


def test_equals_whole_table_upsert(spark, tmp_path, most=3):
    whole, mine = spark.createDataFrame([], SCHEMA), table(spark, str(tmp_path), most_deltas=most)
    mine.create()
    for number, (run, keys) in enumerate(BATCHES):
        new = batch(spark, run, keys)
        links = mine.store(new, number)
        before = whole
        whole = H.upsert(whole, new, ["title"]).drop("changed")
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        stored = {r.posting_id: r.url_key for r in mine.read().collect()}
        assert {stored[r.posting_id] for r in links.collect()} == {k for k in keys if k}
        assert {stored[r.posting_id] for r in links.filter("is_new").collect()} == {k for k in keys if k} - {r.url_key for r in before.collect()}
        # ids are given in the order of buckets, so they are compared as a set of dense numbers
        assert sorted(stored) == list(range(1, whole.count() + 1))
        assert [r[1:] for r in sorted(rows(mine.read()), key=lambda r: r[1])] == [r[1:] for r in sorted(rows(whole), key=lambda r: r[1])]
    assert mine.latest() == len(BATCHES)


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    mine = table(spark, str(tmp_path), share=0.5)
    mine.create()
    mine.store(batch(spark, *BATCHES[0]), 0)
    base = {f: os.path.getmtime(tmp_path / f) for f in folders(tmp_path) if f.startswith("base")}
    mine.store(batch(spark, 9, ["k7"]), 1)
    after = folders(tmp_path)
    assert len([f for f in after if f.startswith("delta/batch=1")]) == 1
    assert {f: os.path.getmtime(tmp_path / f) for f in after if f.startswith("base")} == base
    assert spark.read.parquet(str(tmp_path / "delta/batch=1")).count() == 1
    assert mine.read().filter("url_key = 'k7'").head().last_run_id == 9


def test_a_batch_stored_again_changes_nothing(spark, tmp_path):
    for number, (run, keys) in enumerate(BATCHES[:4]):
        mine = table(spark, str(tmp_path), most_deltas=2)  # a new driver each time
        if not number:
            mine.create()
        first = sorted(map(tuple, mine.store(batch(spark, run, keys), number).collect()))
        held = rows(mine.read())
        again = table(spark, str(tmp_path), most_deltas=2)
        assert sorted(map(tuple, again.store(batch(spark, run, keys), number).collect())) == first
        assert rows(again.read()) == held and again.latest() == number + 1


def test_a_compaction_lost_half_way(spark, tmp_path, monkeypatch):
    mine = table(spark, str(tmp_path), most_deltas=2)
    mine.create()
    for number, (run, keys) in enumerate(BATCHES[:2]):
        mine.store(batch(spark, run, keys), number)
    held = rows(mine.read())

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(PostingTable, "_commit", lost)
    with pytest.raises(RuntimeError):
        mine.store(batch(spark, 5, [f"k{i}" for i in range(30)]), 2)
    monkeypatch.undo()
    again = table(spark, str(tmp_path), most_deltas=2)
    assert again.latest() == 2 and rows(again.read()) == held  # what was written is in no manifest
    again.store(batch(spark, 5, [f"k{i}" for i in range(30)]), 2)
    assert again.read().filter("last_run_id = 5").count() == 30 and again.read().count() == 60


def test_old_versions_are_dropped(spark, tmp_path):
    mine = table(spark, str(tmp_path), most_deltas=2)
    mine.create()
    for number, (run, keys) in enumerate(BATCHES):
        mine.store(batch(spark, run, keys), number)
    named = {os.path.relpath(p, tmp_path) for v in (mine.latest() - 1, mine.latest()) for ps in mine._paths(*[mine._manifest(v)[0]] * 2) for p in ps}
    found = folders(tmp_path)
    own = {f for f in found if f.startswith(f"delta/batch={mine.latest() - 1}/") or f.startswith(f"delta/batch={mine.latest() - 2}/")}
    assert {f for f in found if not f.startswith("manifest")} == named | own  # deltas of the versions kept may be merged already
    assert [f for f in found if f.startswith("manifest")] == [f"manifest/version={mine.latest() - 1}", f"manifest/version={mine.latest()}"]
    assert mine.read(mine.latest() - 1).count() == mine.read().count()


def test_an_empty_table(spark, tmp_path):
    mine = table(spark, str(tmp_path))
    mine.create()
    assert mine.read().count() == 0 and mine.latest() == 0
    assert mine.store(batch(spark, 1, [None, ""]), 0).count() == 0 and mine.read().count() == 0
