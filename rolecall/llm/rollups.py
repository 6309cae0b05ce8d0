"""Token counts as delta-maintained rollups with idempotent batch commits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .exchange import prepare

KEYS = ["source", "lang", "tokenizer_version"]
LEDGER = "doc_id bigint, source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint"
DELTAS = "source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint"


class Rollups:
    """Totals of documents and tokens by source, language and tokenizer version, kept as signed deltas.

    A batch of changes (doc_id, op, source, lang, tokenizer_version, n_tokens, seq) is turned into signed rows: an insert adds,
    a delete takes away what the document counts now, a revision does both. The signed rows of a batch go to
    ledger/batch=N and their sums to deltas/batch=N, each replaced as a whole; a document's present count is the sum
    of its ledger rows in earlier batches. Committing a batch again therefore writes the same rows to the same
    place, and totals only add up deltas. Batches are committed in order of their number by one writer at a time; to redo
    batch N with other rows, redo the later ones after it.

    Defined results: op is insert, revise or delete, anything else (NULL too) is no change; an insert of a known document is
    a revision and a revision of an unknown one an insert; deleting an unknown one changes nothing; of several changes to a document
    in a batch the last by seq counts (ties: the largest n_tokens); a NULL doc_id cannot be found again, so each such
    insert is added and each such delete or revision ignored; NULL source, language or version is a key of its own; a NULL
    n_tokens is 0; an empty batch is a commit without rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def _batches(self, table: str, schema: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, number: int, changes: DataFrame, before: list[int]) -> None:
        """Commit a batch; `before` names the batches committed with a smaller number."""
        clean = changes.select(F.col("doc_id").cast("bigint").alias("doc_id"), "op", *[F.col(k).cast("string").alias(k) for k in KEYS],
                               F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"), "seq").filter("op in ('insert', 'revise', 'delete')")
        last = clean.filter("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("op", *KEYS, "n_tokens"), F.struct("seq", "n_tokens", "op")).alias("c"))
        last = last.select("doc_id", "c.*")
        added = last.filter("op <> 'delete'").union(clean.filter("doc_id is null and op = 'insert'").select(*last.columns)).select(
            "doc_id", *KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        now = (self._batches("ledger", LEDGER, [b for b in before if b < number]).filter("doc_id is not null")
               .join(last.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("n"), F.sum("d_tokens").alias("t")))
        taken = now.filter("n <> 0 or t <> 0").select("doc_id", *KEYS, (-F.col("n")).alias("d_docs"), (-F.col("t")).alias("d_tokens"))
        added.union(taken).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/ledger/batch={number}")
        sums = self._batches("ledger", LEDGER, [number]).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={number}")

    def totals(self, numbers: list[int]) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) after the named batches; keys without documents are left out."""
        return (self._batches("deltas", DELTAS, numbers).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
                .filter("n_docs <> 0 or n_tokens <> 0"))


def as_changes(counted: DataFrame, op: str, seq: Column) -> DataFrame:
    return counted.select("doc_id", F.lit(op).alias("op"), *KEYS, "n_tokens", seq.alias("seq"))
