"""Shared helpers: tables in the shared folder, documents packed into chunks, and questions asked of hash partitions.

Corpus-wide look-ups (is this passage elsewhere? how often does this word pair occur?) are not done row by row. Documents are
packed into chunks of bounded size and stored. A chunk sends each hash partition one compressed array of keys, the
partition joins the arrays of all chunks, and every chunk gets back one array of answers in the order it asked. A key
that is hot in the corpus is one entry per chunk, so no partition grows with a hot key, and each phase moves a few
bytes per key instead of a row.
"""
from __future__ import annotations

import ctypes
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder

HOME = str(Path(__file__).resolve().parents[2])
CHUNK_BYTES = 12_000_000
PART_BYTES = 12_000_000
ASK = "part int, chunk string, blob binary"
ANSWER = "chunk string, kind string, part int, blob binary"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings these operators rely on: UTC, and Arrow batches small enough for very long texts."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    workers = spark.sparkContext.environment  # of Python workers; where the library isn't installed they take it from here
    workers.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # one heap for Arrow and numpy, which give_back empties
    if HOME not in workers.get("PYTHONPATH", ""):
        workers["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, workers.get("PYTHONPATH")]))
    return spark


_GIVEN_BACK = [0.0]


def give_back(every: float = 0.25) -> None:
    """Return what this worker has freed to the system, at most once in `every` seconds.

    Workers live through many stages, and two of them share an executor's memory with its JVM; a freed array would else
    stay with the worker that first needed it.
    """
    now = time.monotonic()
    if now - _GIVEN_BACK[0] >= every:
        _GIVEN_BACK[0] = now
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
        if trim:
            trim(0)


def giving_back(items: Iterator) -> Iterator:
    """The items one by one; memory freed meanwhile is returned before the next, and when they end."""
    for x in items:
        yield x
        del x
        give_back()
    give_back(0)


_SCRATCH: list[str] = []


def stored(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of executors.

    Scratch tables are those `drop_scratch` removes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch:
        _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables `stored` has written so far in this session; only for callers whose results were written elsewhere."""
    paths, _SCRATCH[:] = list(_SCRATCH), []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)  # the file system Spark itself wrote to, whichever it is
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession, total_bytes: int, per_part: int = PART_BYTES) -> int:
    """Number of hash partitions such that each holds a bounded share of the corpus."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 8, -(-int(total_bytes) // per_part))


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed blob, bytes of equal weight together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = zstandard.compress(planes, 3)
        out.append(np.array([len(a), len(body)], np.int64).tobytes() + a.dtype.str.encode().ljust(8) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, size = np.frombuffer(blob, np.int64, 2, at)
        kind = np.dtype(blob[at + 16:at + 24].decode().strip())
        raw = zstandard.decompress(blob[at + 24:at + 24 + size]) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind) if n else np.empty(0, kind))
        at += 24 + int(size)
    return out


def sorted_delta(keys: np.ndarray) -> np.ndarray:
    """Sorted unsigned keys as differences, which compress; undone by cumsum."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def bytes_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def chunked(docs: DataFrame, encode: Callable[[pa.Table], bytes], size: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Documents packed into stored chunks (chunk, n_bytes, payload) of about `limit` text bytes, a longer text alone.

    Chunk ids are drawn once and written with the chunk, so a later retry reads the same chunks in the same order.
    """
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_pydict({"chunk": [uuid.uuid4().hex], "n_bytes": [n], "payload": pa.array([encode(table)], pa.binary())},
                                              schema=out)

        for b in giving_back(batches):
            if not b.num_rows:
                continue
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.names.index(size))), 0), np.int64)
            start = 0
            for i, more in enumerate(lengths):
                if n and n + more > limit:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    yield flush()
                    held, n, start = [], 0, i
                n += int(more)
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield flush()

    import pyarrow.compute  # noqa: F401
    out = pa.schema([("chunk", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
    return stored(docs.mapInArrow(pack_rows, "chunk string, n_bytes bigint, payload binary"), "chunks")


def total_size(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]


def ask(questions: DataFrame, answer: Callable[[list[list[np.ndarray]]], tuple[list[bytes], bytes | None]], kind: str, name: str) -> DataFrame:
    """Answer all questions of a hash partition together.

    `questions` has (part, chunk, blob). `answer` gets the unpacked blobs of one partition and returns one answer per
    blob, and perhaps a summary of the partition (stored with chunk NULL). Result: stored (chunk, kind, part, blob).
    """
    def one_part(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        group = group.sort_values("chunk", ignore_index=True)
        replies, summary = answer([unpack(b) for b in group["blob"]])
        rows = pd.DataFrame({"chunk": group["chunk"], "kind": kind, "part": group["part"], "blob": replies})
        if summary is not None:
            rows.loc[len(rows)] = [None, kind, group["part"].iloc[0], summary]
        return rows

    return stored(questions.groupBy("part").applyInPandas(one_part, ANSWER), name)


def with_answers(chunks: DataFrame, answers: DataFrame, each: Callable[[str, bytes, dict[str, dict[int, bytes]]], pd.DataFrame], schema: str) -> DataFrame:
    """Bring every chunk together with the answers it got and map it: each(chunk id, payload, {kind: {part: blob}})."""
    def one_chunk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        got: dict[str, dict[int, bytes]] = {}
        for kind, part, blob in zip(right["kind"], right["part"], right["blob"], strict=True):
            got.setdefault(kind, {})[part] = blob
        return each(left["chunk"].iloc[0], left["payload"].iloc[0], got)

    asked = answers.filter(F.col("chunk").isNotNull())
    return chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(one_chunk, schema)


def crc_of_id(doc_id):
    """crc32 of the id written as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc_of_id_value(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())
