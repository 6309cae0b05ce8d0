"""Live counts of postings per company, kept by signed changes.

A batch that lists a posting again takes its old row away (-1) and adds its new one (+1), so a posting that changed or
moved leaves the company and the filter it counted for. Sums are kept by company and last run, because which run marks
a posting missing or closed depends on the run that listed it last and on later runs alone: closings need no change
of their own, they follow from the runs when the counts are read.

    delta/batch=N    sums of batch N, one row for each company, last run and side of the filter it touched
    base/upto=N      sums of all batches up to N
    folds/upto=N     one row, written after the base it stands for
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import history as H
from ..session import remove_folder

SUMS = "domain string, last_run_id bigint, matching boolean, n bigint"
KEY = ["domain", "last_run_id", "matching"]


class LiveTotals:
    """Totals under a folder of the shared file system; `matching` is the filter, a condition on a posting's row.

    Every `every` batches the deltas are folded into a new base; the base before it and its deltas stay until the next
    fold, so the last batch can be committed again. Numbers start at 0 and grow by one.
    """

    def __init__(self, spark: SparkSession, folder: str, matching: Column, every: int = 16):
        self.spark, self.folder, self.matching, self.every = spark, folder.rstrip("/"), matching, every

    def create(self) -> None:
        none = self.spark.createDataFrame([], SUMS)
        none.write.mode("overwrite").parquet(f"{self.folder}/delta/batch=-1")
        self._put_base(none, -1)

    def _put_base(self, sums: DataFrame, upto: int) -> None:
        sums.write.mode("overwrite").parquet(f"{self.folder}/base/upto={upto}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/folds/upto={upto}")

    def _folds(self) -> list[int]:
        """Numbers of the bases that are whole: two or three."""
        rows = self.spark.read.schema("id bigint, upto bigint").parquet(f"{self.folder}/folds").select("upto").distinct().collect()
        return sorted(r.upto for r in rows)

    def sums(self) -> DataFrame:
        """Postings by company, last run and side of the filter; sums of nothing are left out."""
        base = self._folds()[-1]
        deltas = self.spark.read.schema(f"{SUMS}, batch bigint").parquet(f"{self.folder}/delta").filter(F.col("batch") > base).drop("batch")
        both = self.spark.read.schema(SUMS).parquet(f"{self.folder}/base/upto={base}").unionByName(deltas)
        return both.groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n <> 0")

    def commit(self, changes: DataFrame, number: int) -> None:
        """Add the signed rows of batch `number` (PostingTable.changes); the same number again replaces it."""
        rows = changes.select("domain", "last_run_id", F.coalesce(self.matching, F.lit(False)).alias("matching"), "sign")
        sums = rows.groupBy(*KEY).agg(F.sum("sign").alias("n")).filter("n <> 0")
        sums.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")
        folds = self._folds()
        if number - folds[-1] >= self.every:
            self._put_base(self.sums(), number)
            self._drop_before(folds)

    def _drop_before(self, folds: list[int]) -> None:
        """Remove the bases before folds[-1], and the deltas it holds."""
        for old in folds[:-1]:
            remove_folder(self.spark, f"{self.folder}/folds/upto={old}")
            remove_folder(self.spark, f"{self.folder}/base/upto={old}")
        first = folds[-2] + 1 if len(folds) > 1 else 0
        for number in range(first, folds[-1] + 1):
            remove_folder(self.spark, f"{self.folder}/delta/batch={number}")

    def read(self, runs: DataFrame) -> DataFrame:
        """domain, matching, total, open_matching, open: all postings of a company, and those that no run has closed."""
        moment = runs.schema["finished_at"].dataType
        unmarked = self.sums().withColumns({c: F.lit(None).cast(moment) for c in ("missing_since", "closed_at")})
        marked = H.with_marks(unmarked, runs)
        n, is_open = F.col("n"), F.col("closed_at").isNull()

        def total(*tests: Column) -> Column:
            value = n
            for test in tests:
                value = F.when(test, value).otherwise(0)
            return F.sum(value).cast("bigint")

        return marked.groupBy("domain").agg(
            total(F.col("matching")).alias("matching"), total().alias("total"),
            total(F.col("matching"), is_open).alias("open_matching"), total(is_open).alias("open")).filter("total > 0")
