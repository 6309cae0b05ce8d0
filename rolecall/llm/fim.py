"""Fill-in-middle transformation by secondary sort.

A document is cut into prefix, middle and suffix; each part is emitted in pieces of PIECE characters, keyed by document and
by the piece's place in the output. repartitionAndSortWithinPartitions brings the pieces of a document together in
that order, so a task reads one document after the other as a stream and never holds a whole text. The restoration reads
that stream, finds the marks in it, and sorts what stands between them back into the original order.
"""
from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, Row, functions as F

from .exchange import prepare

PIECE = 16_384
PARTITION_BYTES = 64_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # of the parts in the document

# key of a piece: (partition hash, document key, place in the output); place -1 carries (doc_id, n, form, prefix, middle)
Piece = tuple[tuple[int, tuple, int], object]


def cut(doc_id: int | None, text: str, plain_percent: int = 10, spm_percent: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle), in characters; decided by the id and the text alone."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(mark in text for mark in PLACE) or h3 % 100 >= 100 - plain_percent:
        return "plain", 0, len(text)
    a, b = h1 % (len(text) + 1), h2 % (len(text) + 1)
    return "spm" if h4 % 100 < spm_percent else "psm", min(a, b), max(a, b)


def pieces_of(text: str, form: str, first: int, second: int) -> Iterator[str]:
    """The output in pieces: each part begins with its mark."""
    if form == "plain":
        spans = [("", 0, len(text))]
    else:
        ends = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
        spans = [(mark, *ends[mark]) for mark in ORDERS[form]]
    for mark, start, stop in spans:
        yield mark + text[start:min(stop, start + PIECE)]
        for at in range(start + PIECE, stop, PIECE):
            yield text[at:min(stop, at + PIECE)]


def assembled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plain_percent: int = 10, spm_percent: int = 20) -> RDD:
    """Pieces of the outputs, partitioned by document and sorted by document and output place.

    A document's key is its id, the checksum of its text, the task that read it and its number among equal rows there, so
    copies of a row spread over partitions, and a task that runs again makes the same keys from the same rows.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES + 1)

    def emit(task: int, rows: Iterator[Row]) -> Iterator[Piece]:
        seen: Counter = Counter()
        for doc_id, text in rows:
            same = doc_id is not None, doc_id or 0, zlib.crc32(text.encode())
            key = (*same, task, seen[same])
            seen[same] += 1
            to = zlib.crc32(repr(key).encode())
            form, first, second = cut(doc_id, text, plain_percent, spm_percent)
            yield (to, key, -1), (doc_id, len(text), form, first, second - first)
            for place, piece in enumerate(pieces_of(text, form, first, second)):
                yield (to, key, place), piece

    pieces = source.rdd.mapPartitionsWithIndex(emit)
    return pieces.repartitionAndSortWithinPartitions(parts, partitionFunc=_by_document)


def _by_document(key: tuple) -> int:
    return key[0]


def split_marks(pieces: Iterator[str], marks: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(mark, text) of a stream whose parts begin with these marks in this order; a mark may lie over two pieces."""
    held, at, nothing = "", -1, ""
    for piece in pieces:
        held += piece
        while at + 1 < len(marks) and (found := held.find(marks[at + 1])) >= 0:
            if at >= 0:
                yield marks[at], held[:found]
            held, at = held[found + len(marks[at + 1]):], at + 1
        keep = len(marks[at + 1]) - 1 if at + 1 < len(marks) else 0
        if at >= 0 and len(held) > keep:
            yield marks[at], held[:len(held) - keep]
            held = held[len(held) - keep:] if keep else nothing
    if held:
        yield marks[at], held


def _documents(pieces: Iterator[Piece]) -> Iterator[tuple[tuple, tuple, Iterator[str]]]:
    """(key, what place -1 carries, stream of the pieces) of each document of a sorted partition."""
    ahead = next(pieces, None)

    def stream(key: tuple) -> Iterator[str]:
        nonlocal ahead
        while ahead is not None and ahead[0][:2] == key:
            piece, ahead = ahead[1], next(pieces, None)
            yield piece

    while ahead is not None:
        (to, key, _), about = ahead
        ahead = next(pieces, None)
        rest = stream((to, key))
        yield (to, key), about, rest
        for _ in rest:  # what the caller left unread
            pass


def outputs(assembled_pieces: RDD, spark) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the transformed texts."""
    def run(pieces):
        for _, (doc_id, n, form, prefix, middle), stream in _documents(iter(pieces)):
            plain = form == "plain"
            yield doc_id, n, form, None if plain else prefix, None if plain else middle, "".join(stream)

    return spark.createDataFrame(assembled_pieces.mapPartitions(run), "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def digests(assembled_pieces: RDD, spark) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), without holding a text.

    The first sort's stream feeds the digest of the output; from the same stream and the form alone the restoration
    makes pieces keyed by document and original place, which are sorted within the partition they are in.
    """
    def read(pieces):
        for (to, key), (doc_id, n, form, prefix, middle), stream in _documents(iter(pieces)):
            digest = hashlib.sha256()

            def heard(stream=stream, digest=digest):
                for piece in stream:
                    digest.update(piece.encode())
                    yield piece

            if form == "plain":
                for place, piece in enumerate(heard()):
                    yield (to, key, (0, place)), piece
            else:
                place = Counter()
                for mark, piece in split_marks(heard(), ORDERS[form]):
                    yield (to, key, (PLACE[mark], place[mark])), piece
                    place[mark] += 1
            plain = form == "plain"
            yield (to, key, (-1, 0)), (doc_id, n, form, None if plain else prefix, None if plain else middle, digest.hexdigest())

    def restore(pieces):
        for _, about, stream in _documents(iter(pieces)):
            digest = hashlib.sha256()
            for piece in stream:
                digest.update(piece.encode())
            yield (*about, digest.hexdigest())

    # the partitioner stays the same, so this sorts where the pieces are and moves nothing
    again = assembled_pieces.mapPartitions(read, preservesPartitioning=True)
    again = again.repartitionAndSortWithinPartitions(assembled_pieces.getNumPartitions(), partitionFunc=_by_document)
    return spark.createDataFrame(again.mapPartitions(restore), (
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"))


def transform(docs: DataFrame, **options) -> DataFrame:
    """Fill-in-middle outputs of all documents: doc_id, n, form, prefix_chars, middle_chars, output; see `cut`.

    Defined results, here and for `transform_digests`: NULL and empty texts are plain and empty; a NULL doc_id is written
    as nothing when its cut is drawn; every repeated row gets a row; an empty table gives no rows; further columns are
    not read, whatever they are called.
    """
    return outputs(assembled(docs, **options), docs.sparkSession)


def transform_digests(docs: DataFrame, **options) -> DataFrame:
    """Digests of the outputs and of the texts restored from them, in place of the texts."""
    return digests(assembled(docs, **options), docs.sparkSession)
