"""Structured Streaming: landed rows into the posting history, batch by batch.

Tables have numbered versions. Batch n reads version n and writes version n + 1, so a batch that is run again after a
failure writes the same version again and nothing is counted twice. Postings are kept in `table.PostingTable`.
"""
from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as H
from ..operators.filters import JobFilter, conditions
from .table import PostingTable
from .totals import LiveTotals


class Snapshots:
    """Versions of a table under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, version: int) -> str:
        return f"{self.folder}/v={version:012d}"

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(version))

    def latest(self) -> int:
        """The newest version that was written to its end."""
        files = self.spark.read.parquet(self.folder).inputFiles()
        return max(int(re.search(r"/v=(\d+)/", name).group(1)) for name in files)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self.path(version))


def without_repeats(rows: DataFrame, event_time: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Streaming rows without the repeats a run lists while it is read (state is dropped after `within`)."""
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def ingest(rows: DataFrame, postings: PostingTable, links: str, checkpoint: str, available_now: bool = False,
           totals: LiveTotals | None = None) -> StreamingQuery:
    """Stream of conformed rows (run_id, pos, domain, url_key, seen_at, fields) -> the posting table and run links.

    The table must have been created. Its `history` adds the missing and closed marks. `totals`, created too, are kept
    up with what each batch changes.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            postings.store(batch, number).write.mode("overwrite").parquet(f"{links}/batch={number}")
            if totals is not None:
                totals.commit(postings.changes(batch, number), number)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def close_missing(finished: DataFrame, runs: Snapshots, postings: Snapshots, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Stream of finished runs -> the runs table and the postings' missing and closed marks, as versions.

    Runs on its own posting versions, after the ingest of the runs it is given. Which run marks a posting follows from
    the runs table alone, so any number of runs per batch gives what one run at a time would.
    """
    def store(batch: DataFrame, number: int) -> None:
        known = runs.read(number)
        runs.write(known.join(batch.select("run_id"), "run_id", "left_anti").unionByName(batch.select(*known.columns)), number + 1)
        postings.write(H.with_marks(postings.read(number), runs.read(number + 1)), number + 1)

    writer = finished.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def live_counts(rows: DataFrame, job_filter: JobFilter, gazetteer) -> DataFrame:
    """Streaming counts per company: matching and all. Partial counts are combined before the shuffle."""
    tests = list(conditions(job_filter.checked(gazetteer), gazetteer).values())
    keep = F.lit(True)
    for test in tests:
        keep = keep & test
    return rows.groupBy("domain").agg(F.count_if(keep).alias("matching"), F.count("*").alias("total"))


def write_counts(counts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Changed companies after each batch, refreshed at most every two and a half seconds; `read_counts` gives the newest."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2.5 seconds")).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest counts of every company over all batches: domain, matching, total."""
    newest = F.max_by(F.struct("matching", "total"), "batch").alias("c")
    return spark.read.parquet(path).groupBy("domain").agg(newest).select("domain", "c.matching", "c.total")
