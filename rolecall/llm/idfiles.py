"""Token ids in binary files: ids numbered by frequency, one to four bytes each, with separate control bytes.

The commonest id of the corpus is rank 0, so most ids take one byte. Four ids share a control byte that holds their
lengths, two bits each; the bytes of the ranks follow apart from it. Readers look a control byte up in a table of 256 rows
and need no loop over ids.

A data set is a folder: `ranks` (Parquet: rank, id, count), `files` (Parquet: one row for each file) and the files.
File, all numbers little-endian:
    8 bytes   magic RCIDS001
    4 x int64 documents, ids, data bytes, ids of the same range partition before this file
    int64 each, for every document: doc_id; then one byte each: 1 if doc_id is NULL; then int64 each: number of ids
    control bytes, one for four ids, the first id in the lowest bits; then the data bytes, each rank's lowest byte first
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keyed import with_known_size
from ..session import shared_folder
from .exchange import prepare, stored
from .tokens import END, WordEncoder

MAGIC = b"RCIDS001"
FILE_IDS = 16_000_000     # a file is closed after so many ids; a longer document has a file to itself
RANGE_IDS = 16_000_000    # ids in one range partition, about
READERS = 20_000          # tasks that read files, at most
SLICE = 1 << 20           # ids coded or decoded at once; a multiple of four
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[:len(ranks)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, n: int, read: Callable[[int], bytes]) -> np.ndarray:
    """n ranks; `read` gives the next so many data bytes."""
    length = LENGTHS[control].reshape(-1)[:n]
    end = np.cumsum(length, dtype=np.int64)
    data = np.frombuffer(read(int(end[-1]) if n else 0), np.uint8)
    start = end - length
    ranks = data[start].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        ranks[longer] |= data[start[longer] + k].astype("<u4") << np.uint32(8 * k)
    return ranks


def _system(uri: str):
    """File system and path of a URI, as tasks and driver open it."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class IdFiles:
    """A written data set. `ids` maps ranks back to ids; it has at most as many entries as the tokenizer."""
    folder: str
    files: DataFrame
    ids: np.ndarray


def _tokenized(docs: DataFrame, tokenizer: str, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, known, part, at, n, ids) of every document, then for each task one row with at = -1: its counts of ids."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, at, part = WordEncoder.of(tokenizer), 0, TaskContext.get().partitionId()
        counts = np.zeros(1 << 16, np.int64)
        for f in frames:
            blobs = [b + END for b in encoder.encode(f["text"].tolist())]
            ids = np.frombuffer(b"".join(blobs), "<u4")
            seen = np.bincount(ids, minlength=len(counts))
            if len(seen) > len(counts):
                counts = np.pad(counts, (0, len(seen) - len(counts)))
            counts += seen
            short = [b"\2" + np.frombuffer(b, "<u4").astype("<u2").tobytes() if len(seen) <= 1 << 16 else b"\4" + b for b in blobs]
            yield pd.DataFrame({"doc_id": f["doc_id"], "known": f["known"], "part": part, "at": np.arange(at, at + len(f)),
                                "n": [len(b) // 4 for b in blobs], "ids": short})
            at += len(f)
        yield pd.DataFrame({"doc_id": [0], "known": [False], "part": [part], "at": [-1], "n": [0], "ids": [counts.tobytes()]})

    # NULL ids as a column of their own: pandas would turn the others into floating point
    doc_id = F.col(id_column).cast("bigint")
    source = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("known"), F.col(text_column).alias("text"))
    return source.mapInPandas(run, "doc_id bigint, known boolean, part int, at bigint, n bigint, ids binary")


def _ranked(rows: DataFrame) -> DataFrame:
    """(rank, id, count) of all ids that occur: tasks add up the counts of earlier tasks, Spark the rest."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for f in frames:
            for blob in f["ids"]:
                more = np.frombuffer(blob, np.int64)
                total = np.pad(total, (0, max(0, len(more) - len(total))))
                total[:len(more)] += more
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "count": total[used]})

    counts = rows.filter("at < 0").select("ids").mapInPandas(add, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count"))
    # one row for each entry of the tokenizer, however many documents
    return counts.selectExpr("row_number() over (order by count desc, id) - 1 as rank", "id", "count")


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> IdFiles:
    """Write the ids of whole texts, each followed by id 1, in ascending doc_id order to files under `folder`.

    `tokenizer` names a tokenizers file of words that are never joined over white space. Documents are sorted by range, so
    file after file holds ascending ids; ranges are cut by rows, files by ids. A task that runs again writes the same
    bytes to the same name, and a name appears once its file is whole. Defined results: NULL and empty texts are one id
    (1); a NULL doc_id comes first and stays NULL; rows with equal doc_id stand together, in the order they were read; an
    empty table gives no file; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    folder = (folder or f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}").rstrip("/")
    rows = stored(_tokenized(docs, tokenizer, id_column, text_column), "tokens")
    _ranked(rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    home = spark.read.parquet(f"{folder}/ranks").inputFiles()[0].rsplit("/ranks/", 1)[0]  # with its scheme
    ids = _read_ranks(spark, folder)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, "<u4")
    rank_of[ids] = np.arange(len(ids))
    documents = rows.filter("at >= 0")
    total = documents.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_IDS + 1)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _system(home)
        part, sequence, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pd.DataFrame:
            ranks = rank_of[np.concatenate(held)]
            coded = [encode_ranks(ranks[i:i + SLICE]) for i in range(0, len(ranks), SLICE)]
            name = f"range-{part:07d}-{sequence:05d}.ids"
            size = sum(len(d) for _, d in coded)
            system.create_dir(f"{top}/data", recursive=True)
            own = f"{top}/data/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(MAGIC + np.array([len(held), len(ranks), size, before], "<i8").tobytes())
                out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids))
                out.write(np.array([len(h) for h in held], "<i8").tobytes())
                for k in (0, 1):
                    for pair in coded:
                        out.write(pair[k])
            system.move(own, f"{top}/data/{name}")
            return pd.DataFrame({"part": [part], "sequence": [sequence], "file": [name], "documents": [len(held)], "ids": [len(ranks)], "data_bytes": [size]})

        waiting = 0
        for f in frames:
            for doc_id, known, blob in zip(f["doc_id"].tolist(), f["known"].tolist(), f["ids"], strict=True):
                held.append(np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1))
                doc_ids.append(doc_id if known else None)
                waiting += len(held[-1])
                if waiting >= FILE_IDS:
                    yield close()
                    held, doc_ids, sequence, before, waiting = [], [], sequence + 1, before + waiting, 0
        if held:
            yield close()

    order = ["known", "doc_id", "part", "at"]
    by_range = documents.select(*order, "ids").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    written = by_range.select("doc_id", "known", "ids").mapInPandas(write, "part int, sequence int, file string, documents bigint, ids bigint, data_bytes bigint")
    written.write.mode("overwrite").parquet(f"{folder}/files")
    return open_ids(spark, folder)


def _read_ranks(spark: SparkSession, folder: str) -> np.ndarray:
    """Ids by rank: as many rows as the tokenizer has entries at most."""
    rows = spark.read.parquet(f"{folder}/ranks").select("rank", "id").toPandas().sort_values("rank")
    return rows["id"].to_numpy(np.int64)


def open_ids(spark: SparkSession, folder: str) -> IdFiles:
    return IdFiles(folder, spark.read.parquet(f"{folder}/files"), _read_ranks(spark, folder))


def read_file(uri: str, ids: np.ndarray) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """(doc_id, ids of the partition before the document, arrays of ids) of every document of a file, a slice at a time."""
    system, path = _system(uri)
    ids = ids.astype("<u4")
    with system.open_input_file(path) as file, system.open_input_file(path) as data:
        if file.read(8) != MAGIC:
            raise ValueError(f"not a file of ids: {uri}")
        n, total, _, before = np.frombuffer(file.read(32), "<i8").tolist()
        doc_ids, missing = np.frombuffer(file.read(8 * n), "<i8"), file.read(n)
        lengths = np.frombuffer(file.read(8 * n), "<i8")
        data.seek(file.tell() + -(-total // 4))
        held, left = np.empty(0, "<u4"), total

        def more() -> None:
            nonlocal held, left
            count = min(SLICE, left)
            control = np.frombuffer(file.read(-(-count // 4)), np.uint8)
            held, left = ids[decode_ranks(control, count, data.read)], left - count

        def document(length: int) -> Iterator[np.ndarray]:
            nonlocal held
            while length:
                if not len(held):
                    more()
                take, held = held[:length], held[length:]
                length -= len(take)
                yield take

        for doc_id, null, length in zip(doc_ids.tolist(), missing, lengths.tolist(), strict=True):
            yield None if null else doc_id, before, document(length)
            before += length


def read_ids(written: IdFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start counts the ids of all documents before."""
    spark = written.files.sparkSession
    home = spark.read.parquet(f"{written.folder}/ranks").inputFiles()[0].rsplit("/ranks/", 1)[0]
    ids = written.ids.astype("<u4")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, name in zip(f["part"], f["file"], strict=True):
                rows = []
                for doc_id, at, pieces in read_file(f"{home}/data/{name}", ids):
                    crc, n = 0, 0
                    for piece in pieces:
                        crc, n = zlib.crc32(piece.tobytes(), crc), n + len(piece)
                    rows.append((doc_id, part, at, n, crc))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    # one row for each range partition
    sizes = written.files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = sizes.selectExpr("part", "sum(n) over (order by part) - n as base")
    names = written.files.select("part", "file").repartition(max(1, min(written.files.count(), READERS)))
    rows = names.mapInPandas(read, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(with_known_size(before), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "part", "at", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})
