"""The stored posting table: a base in hash buckets, small deltas above it, and a manifest that says what counts.

    base/generation=G/bucket=B     whole rows of a bucket, as compacted by batch G
    delta/batch=N/bucket=B         rows of the keys batch N touched, whole, newer than the base
    manifest/version=N             one row for each bucket: its generation, its deltas and their rows, the largest posting id

Batch N reads version N and writes version N + 1. It reads the buckets its keys fall into and writes its own keys; a
bucket is written whole only when its deltas have grown to a share of its base, so the work of a batch follows the
batch and a row is rewritten a bounded number of times while the table doubles. The manifest is one small file and is
written last: what a batch left unfinished is not in any manifest, and the batch run again writes it again.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import history as H
from ..operators.keyed import with_known_size
from ..session import remove_folder

MANIFEST = "bucket int, generation bigint, base_rows bigint, deltas array<bigint>, delta_rows bigint, top bigint"


@dataclass(frozen=True)
class Bucket:
    """What the manifest says of a bucket. generation is None while it has no base."""
    generation: int | None = None
    base_rows: int = 0
    deltas: tuple[int, ...] = field(default=())
    delta_rows: int = 0


class PostingTable:
    """Postings by url_key under a folder of the shared file system.

    `buckets` is fixed when the table is created; `files` tasks write each bucket. A bucket is compacted when it has
    `most_deltas` deltas, or when their rows exceed `share` of its base. The last `keep` versions stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, fields: list[str], buckets: int = 64, files: int = 1,
                 most_deltas: int = 16, share: float = 0.25, keep: int = 2):
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.buckets, self.files, self.most_deltas, self.share, self.keep = buckets, files, most_deltas, share, max(2, keep)
        self._written: dict[int, tuple[dict[int, Bucket], int]] = {}  # manifests this instance wrote, for the versions kept

    # ---- versions ----

    def create(self) -> None:
        self._commit(0, {}, 0)

    def latest(self) -> int:
        """The newest version; the folder holds a manifest for each version kept and no more."""
        return self.spark.read.parquet(f"{self.folder}/manifest").agg(F.max("version")).head()[0]

    def _manifest(self, version: int) -> tuple[dict[int, Bucket], int]:
        """The buckets of a version and its largest posting id: one row for each bucket."""
        if version in self._written:
            return self._written[version]
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={version}").collect()
        known = {r.bucket: Bucket(r.generation, r.base_rows, tuple(r.deltas), r.delta_rows) for r in rows if r.bucket >= 0}
        return known, rows[0].top

    def _commit(self, version: int, known: dict[int, Bucket], top: int) -> None:
        rows = [(b, k.generation, k.base_rows, list(k.deltas), k.delta_rows, top) for b, k in sorted(known.items())] or [(-1, None, 0, [], 0, top)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self._written = {v: m for v, m in self._written.items() if version - self.keep <= v < version} | {version: (known, top)}

    # ---- reading ----

    def _paths(self, known: dict[int, Bucket], buckets: Iterable[int]) -> tuple[list[str], list[str]]:
        mine = [(b, known[b]) for b in sorted(buckets) if b in known]
        base = [f"{self.folder}/base/generation={k.generation}/bucket={b}" for b, k in mine if k.generation is not None]
        return base, [f"{self.folder}/delta/batch={n}/bucket={b}" for b, k in mine for n in k.deltas]

    def _load(self, kind: str, extra: str, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, *T.StructType.fromDDL(extra).fields])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _rows(self, known: dict[int, Bucket], buckets: Iterable[int]) -> DataFrame:
        """Rows of some buckets: of each key the newest delta, else the base's. The base is filtered, not sorted."""
        base, delta = self._paths(known, buckets)
        columns = self.schema.fieldNames()
        rows = self._load("base", "generation bigint, bucket int", base).select(*columns)
        if not delta:
            return rows
        deltas = self._load("delta", "batch bigint, bucket int", delta)
        newest = deltas.groupBy("url_key").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")
        if not base:
            return newest
        return rows.join(with_known_size(deltas.select("url_key").distinct()), "url_key", "left_anti").select(*columns).unionByName(newest)

    def read(self, version: int | None = None) -> DataFrame:
        """All postings of a version, the newest by default."""
        known, _ = self._manifest(self.latest() if version is None else version)
        return self._rows(known, known)

    def history(self, runs: DataFrame, version: int | None = None) -> DataFrame:
        """All postings with the missing and closed marks that follow from the runs.

        A posting's marks depend on the run that listed it last and on later runs alone, so nothing is stored for them
        and a finished run rewrites no posting.
        """
        return H.with_marks(self.read(version), runs)

    # ---- writing ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url_key"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        spread = F.pmod(F.hash("url_key"), F.lit(self.files))
        (rows.withColumn("bucket", self._bucket()).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(path))

    def _touched(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """The keys of a batch and the numbers of the buckets they fall into."""
        keys = batch.filter(F.coalesce("url_key", F.lit("")) != "").select("url_key", self._bucket().alias("bucket")).distinct()
        return keys, [r.bucket for r in keys.select("bucket").distinct().collect()]

    def store(self, batch: DataFrame, number: int) -> DataFrame:
        """Merge batch `number` into version `number` and commit the next one; returns the links of the batch.

        Columns of the batch: run_id, pos, domain, url_key, seen_at and the fields. Rows without a key are left out. The
        same number stored again gives the same version again.
        """
        known, top = self._manifest(number)
        keys, touched = self._touched(batch)
        before = self._rows(known, touched).join(keys.select("url_key"), "url_key", "left_semi")
        path = f"{self.folder}/delta/batch={number}"
        if touched:
            merged = H.upsert(before, batch, self.fields, top=top).drop("changed")
            self._write(merged.select(*self.schema.fieldNames()), path)
            delta = self._load("delta", "batch bigint, bucket int", [f"{path}/bucket={b}" for b in sorted(touched)])
            after, top = self._counted(known, delta, number, top)
            after = self._compacted(after, touched, number)
        else:
            delta, after = self._load("delta", "batch bigint, bucket int", []), known
        links = H.link_rows(H.mark_new(batch, before), delta)
        self._commit(number + 1, after, top)
        self._drop_old(number + 1)
        return links

    def changes(self, batch: DataFrame, number: int) -> DataFrame:
        """Signed rows of the batch stored last: its keys' rows before it with sign -1, those after it with sign 1."""
        keys, touched = self._touched(batch)
        before = self._rows(self._manifest(number)[0], touched).join(keys.select("url_key"), "url_key", "left_semi")
        after = self._load("delta", "batch bigint, bucket int", [f"{self.folder}/delta/batch={number}/bucket={b}" for b in sorted(touched)])
        columns = self.schema.fieldNames()
        return before.select(*columns, F.lit(-1).alias("sign")).unionByName(after.select(*columns, F.lit(1).alias("sign")))

    def _counted(self, known: dict[int, Bucket], delta: DataFrame, number: int, top: int) -> tuple[dict[int, Bucket], int]:
        after = dict(known)
        for r in delta.groupBy("bucket").agg(F.count("*").alias("n"), F.max("posting_id").alias("top")).collect():  # one row for each bucket
            old = known.get(r.bucket, Bucket())
            after[r.bucket] = replace(old, deltas=(*old.deltas, number), delta_rows=old.delta_rows + r.n)
            top = max(top, r.top)
        return after, top

    def _due(self, bucket: Bucket) -> bool:
        return len(bucket.deltas) >= self.most_deltas or bucket.delta_rows > self.share * bucket.base_rows

    def _compacted(self, known: dict[int, Bucket], touched: list[int], number: int) -> dict[int, Bucket]:
        """Touched buckets whose deltas have grown enough get a new base, which the next manifest names."""
        due = [b for b in touched if self._due(known[b])]
        if not due:
            return known
        path = f"{self.folder}/base/generation={number}"
        self._write(self._rows(known, due), path)
        rows = self._load("base", "generation bigint, bucket int", [f"{path}/bucket={b}" for b in sorted(due)])
        sizes = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}
        return {**known, **{b: Bucket(number, sizes[b]) for b in due}}

    def _drop_old(self, version: int) -> None:
        """Remove the version that has just grown too old, and the folders only it names."""
        old = version - self.keep
        if not self.spark.read.parquet(f"{self.folder}/manifest").filter(F.col("version") == old).head(1):
            return  # there is none, or the batch is run again and it went the first time
        gone = self._manifest(old)[0]
        kept = {p for v in range(old + 1, version + 1) for ps in self._paths(*[self._manifest(v)[0]] * 2) for p in ps}
        # deltas that were compacted by the batch that wrote them are in no manifest
        merged = [f"{self.folder}/delta/batch={old - 1}/bucket={b}" for b, k in gone.items() if k.generation == old - 1]
        for paths in (*self._paths(gone, gone), merged):
            for path in paths:
                if path not in kept:
                    remove_folder(self.spark, path)
        remove_folder(self.spark, f"{self.folder}/manifest/version={old}")
