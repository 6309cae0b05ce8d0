"""Writing postings for people: CSV safe for spreadsheets, JSON, per company, per session, and a manifest of files."""
from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..functions.text import safe_cell
from ..operators.keyed import spread
from ..schemas import POSTING_FIELDS
from ..session import remove_folder

PER_FILE = 1_000_000               # rows of one file, at most
AT_ONCE = 10_000                   # names or lines handed on by a task
_BLANK = bytes(range(33))          # a line of these alone is none to Spark's CSV source
_UNNAMED = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}  # in folder names, as Spark's writer does


def export_columns(postings: DataFrame, fields: list[str] | None = None, *also: str) -> DataFrame:
    """Exactly the export columns in their order, text cells made safe."""
    fields = POSTING_FIELDS if fields is None else fields
    text = {f.name for f in postings.schema.fields if isinstance(f.dataType, StringType)}
    return postings.select(*also, *[safe_cell(F.col(f)).alias(f) if f in text else F.col(f) for f in fields])


def write_csv(postings: DataFrame, path: str, fields: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header; many files in parallel unless one is asked for, which only a small result should be."""
    rows = export_columns(postings, fields)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(postings: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """One JSON object per line, written in parallel."""
    postings.select(*(POSTING_FIELDS if fields is None else fields)).write.mode("overwrite").json(path)


def filtered_rows(matching: DataFrame, filters: str, total: int, fields: list[str] | None = None) -> DataFrame:
    """Rows of a filtered JSON export, each naming the filters and counts it was written under."""
    fields = POSTING_FIELDS if fields is None else fields
    counts = matching.agg(F.count("*").alias("matching"))
    return matching.join(F.broadcast(counts)).select(
        F.lit(filters).alias("filters"), "matching", F.lit(total).alias("total"), F.struct(*fields).alias("job"))


def write_companies(postings: DataFrame, path: str, fields: list[str] | None = None, filtered: bool = False) -> None:
    """One folder per company, replacing only the companies written.

    Rows are rebalanced by company first: small companies share a task, a large one is split over several. Where the
    folder is a mounted one (file:), tasks write the files themselves: Spark's local file system starts processes for the
    permissions of every file, and its committer moves the folders one by one on the driver.
    """
    spark, path = postings.sparkSession, f"{path}{'_filtered' if filtered else ''}"
    rows = export_columns(postings, fields, "domain").hint("rebalance", "domain")
    mounted = _mounted(spark, path)
    if mounted is None:
        (rows.write.mode("overwrite").partitionBy("domain").option("partitionOverwriteMode", "dynamic").option("header", True)
         .option("maxRecordsPerFile", PER_FILE).csv(path))
    else:
        _write_folders(rows, mounted)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path as all machines see it in their own file systems; None if another file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _write_folders(rows: DataFrame, path: str) -> None:
    """Files are written aside first; once all are complete, they replace those of their companies. Both by tasks.

    A task that runs again writes files of other names, and only those named by the tasks that ended are moved.
    """
    spark, export = rows.sparkSession, uuid.uuid4().hex
    fields = [c for c in rows.columns if c != "domain"]
    aside = f"{path}/.export-{export}"
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(f).alias(f) for f in fields]))).head()[0]
    lines = rows.select("domain", F.to_csv(F.struct(*fields)).alias("line")).sortWithinPartitions("domain")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{aside}/{uuid.uuid4().hex}"
        os.makedirs(own, exist_ok=True)
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        done: list[tuple[str, str]] = []
        for n, (domain, of_one) in enumerate(itertools.groupby(pairs, key=lambda pair: pair[0])):
            folder = f"domain={domain.translate(_ESCAPED) if domain else _UNNAMED}"
            texts = (line for _, line in of_one)
            for k in itertools.count():
                first = next(texts, None)
                if first is None:
                    break
                done.append((folder, f"{own}/{n}-{k}.csv"))
                with open(done[-1][1], "w", encoding="utf-8", newline="") as file:
                    file.write(f"{header}\n{first}\n")
                    file.writelines(f"{line}\n" for line in itertools.islice(texts, PER_FILE - 1))
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pydict({"folder": [d[0] for d in done], "file": [d[1] for d in done]})
                done = []
        if done:
            yield pa.RecordBatch.from_pydict({"folder": [d[0] for d in done], "file": [d[1] for d in done]})

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, files in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{path}/{folder}"
                os.makedirs(to, exist_ok=True)
                for old in os.listdir(to):
                    if export not in old:
                        os.remove(f"{to}/{old}")
                for i, file in enumerate(sorted(files)):
                    target = f"{to}/part-{i:05}-{export}.csv"
                    if os.path.exists(file) or not os.path.exists(target):  # else an earlier try has moved it
                        os.replace(file, target)
            yield pa.RecordBatch.from_pydict({"companies": pa.array([b.num_rows], pa.int64())})

    try:
        lines.mapInArrow(write, "folder string, file string").write.parquet(f"{aside}/files")
        written = spark.read.schema("folder string, file string").parquet(f"{aside}/files")
        by_folder = written.groupBy("folder").agg(F.collect_list("file").alias("files"))
        by_folder.mapInArrow(publish, "companies bigint").agg(F.sum("companies")).collect()
        with open(f"{path}/_SUCCESS", "w"):
            pass
    finally:
        remove_folder(spark, f"file:{aside}")


def read_companies(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The postings of all companies' folders as text; names and types are given, so that no file is opened to infer them.

    Spark's file source keeps an entry for every file on the driver; a mounted folder is listed by tasks instead.
    """
    fields = POSTING_FIELDS if fields is None else fields
    mounted = _mounted(spark, path)
    if mounted is not None and os.path.isdir(mounted):
        return _read_folders(spark, mounted, fields)
    schema = ", ".join(f"`{f}` string" for f in [*fields, "domain"])
    return spark.read.option("header", True).schema(schema).csv(path)


def _read_folders(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """One task lists the folders, many list and read their files; lines are taken apart as Spark's CSV source does it."""
    def hidden(name: str) -> bool:  # to Spark's file sources
        return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)

    def named(folder: str) -> str | None:
        value = folder.partition("=")[2]
        return None if value == _UNNAMED else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)

    def batches_of(rows: Iterator[tuple], *names: str) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(values) for values in zip(*some, strict=True)], names=list(names))

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                with os.scandir(path) as entries:
                    yield from batches_of(((e.name,) for e in entries if e.name.startswith("domain=") and e.is_dir()), "folder")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((folder, name) for b in batches for folder in b.column(0).to_pylist() for name in os.listdir(f"{path}/{folder}"))
        yield from batches_of(((folder, name) for folder, name in found if not hidden(name)), "folder", "file")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(domains, pa.string()), pa.array(held, pa.binary())], names=["domain", "line"])

        domains, held, size = [], [], 0
        for b in batches:
            for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                domain = named(folder)
                with open(f"{path}/{folder}/{name}", "rb") as file:
                    texts = (text for line in file for text in line.splitlines() if text.strip(_BLANK))
                    next(texts, None)  # the header
                    for text in texts:
                        domains.append(domain)
                        held.append(text)
                        size += len(text)
                        if len(held) >= AT_ONCE or size >= 4_000_000:
                            yield batch()
                            domains, held, size = [], [], 0
        if held:
            yield batch()

    listed = spread(spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string"))
    dealt = spread(listed.mapInArrow(files, "folder string, file string"))
    values = F.from_csv(F.col("line").cast("string"), ", ".join(f"`{f}` string" for f in fields))
    rows = dealt.mapInArrow(lines, "domain string, line binary").select(values.alias("values"), "domain")
    return rows.select("values.*", "domain")


def write_session(matching: DataFrame, path: str, filtered: bool, fields: list[str] | None = None) -> dict:
    """A session's postings; nothing is written when there are none."""
    if matching.isEmpty():
        return {"written": None, "filtered": filtered}
    write_csv(matching, path, fields)
    return {"written": path, "filtered": filtered}


def manifest(spark: SparkSession, path: str, session_start: Column) -> DataFrame:
    """Exported CSV files: name, rows, size, written, this_session; this session's first, then the newest."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
             .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("written")))
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True)
             .schema("first STRING").option("enforceSchema", True).csv(path)
             .groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows")))
    # by whole path: exports of several companies repeat base names; the two readers write file:/ differently
    at = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = files.withColumn("name", F.substring_index("path", "/", -1)).withColumn("at", at("path")).join(
        lines.select(at("file").alias("at"), "rows"), "at", "left")
    return (joined.select("name", F.coalesce("rows", F.lit(0)).alias("rows"), "size", "written",
                          (F.col("written") >= session_start).alias("this_session"))
            .orderBy(F.desc("this_session"), F.desc("written"), "name"))
