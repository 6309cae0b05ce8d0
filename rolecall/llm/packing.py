"""Hierarchical multi-length packing of documents into fixed windows.

A document is cut once: full windows first, then the rest into a head (whole tier units) and a tail (less than a unit).
Full windows go straight out. Heads are routed to tiers by size and laid into windows from the largest tier down; gaps
are filled from the shorter tiers and then, token by token, from the tails, of which there are many of every size. Where
a partition's last pieces leave a gap, they are cut into powers of two, which need no padding. Cuts depend on the
document alone, so ids are made in one pass and only piece lengths are shuffled.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .exchange import give_back, giving_back, prepare, stored
from .tokens import END, Encoder

PIECES_PER_GROUP = 20_000


def _pieces(ids: bytes, window: int, unit: int):
    """(start, length, crc32, crc32 of the power-of-two parts) of the pieces of one document."""
    n, at = len(ids) // 4, 0
    while n - at >= window:
        yield at, window, zlib.crc32(ids[4 * at:4 * (at + window)]), []
        at += window
    for size in ((n - at) // unit * unit, (n - at) % unit):
        if size:
            crcs, lo = [], at
            for bit in range(size.bit_length() - 1, -1, -1):
                if size >> bit & 1:
                    crcs.append(zlib.crc32(ids[4 * lo:4 * (lo + (1 << bit))]))
                    lo += 1 << bit
            yield at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), crcs
            at += size


class _Shelf:
    """Pieces (document row, start, length, crc, crcs of parts) by length, with the longest one not above a limit found at once."""

    def __init__(self):
        self.of: dict[int, list[tuple]] = {}
        self.lengths = 0

    def put(self, piece: tuple) -> None:
        self.of.setdefault(piece[2], []).append(piece)
        self.lengths |= 1 << piece[2]

    def pop(self, length: int) -> tuple:
        pieces = self.of[length]
        piece = pieces.pop()
        if not pieces:
            self.lengths &= ~(1 << length)
        return piece

    def take(self, limit: int) -> tuple | None:
        length = (self.lengths & ((1 << (limit + 1)) - 1)).bit_length() - 1
        return self.pop(length) if length > 0 else None

    def split(self, above: int) -> bool:
        """Cut the shortest piece above a length into its powers of two; False if there is none to cut."""
        rest = self.lengths >> (above + 1)
        while rest:
            length = above + (rest & -rest).bit_length()
            if length & (length - 1):
                for part in _parts(self.pop(length)):
                    self.put(part)
                return True
            rest &= rest - 1
            if not rest:
                break
        return False


def _parts(piece: tuple) -> Iterator[tuple]:
    row, at, left, _, crcs = piece
    for crc in crcs:
        size = 1 << (left.bit_length() - 1)
        yield row, at, size, crc, [crc]
        at, left = at + size, left - size


def lay_out(pieces: list[tuple], window: int, unit: int) -> Iterator[list[tuple]]:
    """Sequences of pieces, each a full window, but for the last pieces, which make sequences of powers of two."""
    heads, tails = _Shelf(), _Shelf()
    for p in pieces:
        if p[2] == window:
            yield [p]
        else:
            (heads if p[2] % unit == 0 else tails).put(p)
    while True:
        gap, row = window, []
        while gap:
            got = heads.take(gap) or tails.take(gap)
            if got:
                gap -= got[2]
                row.append(got)
            elif not (tails.split(gap) or heads.split(gap)):
                break
        if not row:
            return
        if gap == 0 or (window - gap) & (window - gap - 1) == 0:
            yield row
        else:
            for p in row:
                yield from ([part] for part in _parts(p))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, unit: int = 256, step_tokens: int = 1 << 20,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier, step.

    A document is its ids followed by id 1. `window` and `unit` are powers of two. sequence_length is the number of tokens
    in the sequence: a full window, or a power of two for the last pieces of a partition. `tier` is the size the
    document's piece was routed to (the next power of two). Sequences of a step have about step_tokens tokens together,
    and every step takes long and short sequences in proportion. Defined results: NULL and empty texts are one token
    (id 1); repeated rows are packed each; a NULL doc_id is kept; an empty table gives no rows; no further column is read.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, at = Encoder.of(tokenizer), 0
        for f in giving_back(frames):
            rows = []
            for doc_id, ids in zip(f["doc_id"], encoder.encode(f["text"].tolist()), strict=True):
                ids += END
                for start, length, crc, crcs in _pieces(ids, window, unit):
                    rows.append((doc_id, start, length, crc, len(ids) // 4, crcs, at))
                    at += 1
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "at"]).astype({"doc_id": f["doc_id"].dtype})

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    pieces = stored(source.mapInPandas(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, parts array<bigint>, at bigint"), "pieces")
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    groups = max(1, n // PIECES_PER_GROUP, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("ids_crc32", "doc_id", "start", "at"), F.lit(groups)))

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        group = group.sort_values(["ids_crc32", "doc_id", "start", "at"], ignore_index=True)
        pieces = list(zip(range(len(group)), *(group[c].tolist() for c in ("start", "length", "ids_crc32", "parts")), strict=True))
        out = []
        for sequence, row in enumerate(lay_out(pieces, window, unit)):
            total, offset = sum(p[2] for p in row), 0
            for i, start, length, crc, _ in row:
                out.append((i, start, length, crc, sequence, offset, total))
                offset += length
        laid = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "local", "offset", "sequence_length"])
        laid["doc_id"] = group["doc_id"].to_numpy()[laid["i"]] if len(laid) else []
        laid["doc_tokens"] = group["doc_tokens"].to_numpy()[laid["i"]] if len(laid) else []
        laid["group"] = group["group"].iloc[0]
        return laid.drop(columns="i")

    laid = stored(grouped.groupBy("group").applyInPandas(lay, (
        "start bigint, length bigint, ids_crc32 bigint, local bigint, offset bigint, sequence_length bigint, "
        f"doc_id {kind}, doc_tokens bigint, `group` bigint")), "laid")
    # sequences are numbered group after group; there is one row for each group here
    sizes = laid.groupBy("group").agg((F.max("local") + 1).alias("n"), F.sum("length").alias("tokens"))
    before = sizes.selectExpr("group", "sum(n) over (order by group) - n as base")
    tier = F.least(F.lit(window), F.pow(F.lit(2.0), F.ceil(F.log2("length"))).cast("bigint"))
    # sequences are dealt over the steps in turn, so that every step holds long and short ones alike
    steps = max(1, round(total / step_tokens))
    return (laid.join(before, "group").withColumn("sequence_id", F.col("base") + F.col("local"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", tier.alias("tier"),
                    (F.col("sequence_id") % steps).alias("step")))
