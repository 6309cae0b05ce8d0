"""Removal of long repeated passages: sampled suffix buckets refined by bucket-pointer refinement.

Positions are put into buckets by the q-gram that starts there, and a bucket is refined by the bucket identifiers of
later offsets: two positions share a gram of length a + b exactly if they share the bucket of length a and, a bytes
later, the bucket of length b. Identifiers are 64-bit fingerprints of the pair instead of ranks, so a refinement needs
no ranking of the corpus, and each level reuses the one before (1, 2, 3, 5, 10, 20, 25, 50, 100, 200 bytes).
Different grams share an identifier with probability 2^-64 a pair.

Only sampled positions leave their chunk of documents. Of the half-length grams in a window of `length` bytes the one
with the smallest identifier is its anchor: equal windows have equal anchors, about one position in fifty is one.
1. Every anchor asks the partition of its bucket. A bucket of one is dropped. Its context (all windows it is the anchor
   of) is an identifier again, made from the window identifiers at its first and last offset; a repeated context marks
   all its windows.
2. Where a bucket holds different contexts, the window identifiers of each distinct context are asked for one by one.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .exchange import (ask, bytes_table, chunked, giving_back, pack, partitions, prepare, sorted_delta, table_bytes, total_size, unpack, with_answers)

U = np.uint64
ADDED = ["n_bytes", "n_removed", "spans", "kept"]  # columns of the result besides the caller's
SEED = np.random.default_rng(77).integers(0, 2 ** 63, 256, U)
SEGMENT = 500_000
CHUNK = 4_500_000
ALONE, MARKED, SENT_MARKED, SENT = 0, 1, 2, 3


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    x = a * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x += b
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def _longer(a: np.ndarray, offset: int, b: np.ndarray) -> np.ndarray:
    """Refine: buckets at i by the buckets at i + offset."""
    n = min(len(a), len(b) - offset)
    return _join(a[:n], b[offset:offset + n]) if n > 0 else np.empty(0, U)


def _levels(length: int) -> list[tuple[int, int]]:
    """The refinements (a, b) that lead from single bytes to length / 2, each from lengths already known."""
    need, plan = [length // 2], []
    while need:
        n = need.pop()
        if n > 1 and n not in [a + b for a, b in plan]:
            plan.append(((n + 1) // 2, n // 2))
            need += [(n + 1) // 2, n // 2]
    return sorted(set(plan), key=sum)


def _identifiers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the half gram and of the whole window at every offset; `length` is even."""
    at, levels = {1: SEED[data]}, _levels(length)
    for i, (a, b) in enumerate(levels):
        at[a + b] = _longer(at[a], a, at[b])
        later = {length // 2, *(n for pair in levels[i + 1:] for n in pair)}
        at = {n: ids for n, ids in at.items() if n in later}
    half = at[length // 2]
    return half, _longer(half, length // 2, half)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(U).max, U)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1:width - 1 + n])


class Anchors:
    """Anchors of some documents laid end to end; windows never cross a document's end."""

    def __init__(self, texts: list[bytes], length: int):
        self.ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.first = self.last = self.gram = np.empty(0, np.int64)
        if len(data) < length:
            return
        half, self.window = _identifiers(data, length)
        width = length - length // 2 + 1
        bits = U(int(len(data)).bit_length())
        low = _sliding_min(((half >> bits) << bits) | np.arange(len(half), dtype=U), width)
        at = (low & ((U(1) << bits) - U(1))).astype(np.int64)[:len(self.window)]
        ok = np.ones(len(self.window), bool)
        for end in self.ends[:-1]:
            ok[max(0, end - length + 1):end] = False
        at[~ok] = -1
        cuts = np.flatnonzero(np.diff(at, prepend=-2))
        stops = np.append(cuts[1:], len(at)) - 1
        used = at[cuts] >= 0
        self.first, self.last = cuts[used], stops[used]
        self.gram = half[at[self.first]]
        spread = (at[self.first] - self.first).astype(U) << U(32) | (self.last - self.first).astype(U)
        self.context = _join(_join(self.window[self.first], self.window[self.last]), spread)


def _segments(texts: list[bytes]):
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > SEGMENT:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def _texts(table: pa.Table, column: str) -> list[bytes]:
    return [b"" if t is None else t for t in table.column(column).cast(pa.binary()).to_pylist()]


def _by_part(part: np.ndarray, key: np.ndarray):
    """(part number, positions) of each part, positions ordered by key."""
    order = np.lexsort((key, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(part[order[lo]]), order[lo:hi]


def _judge_anchors(blobs: list[list[np.ndarray]]):
    """For each anchor: alone in its bucket, marked by a repeated context, or to be asked window by window."""
    sizes = [len(b[0]) for b in blobs]
    gram = np.concatenate([np.cumsum(b[0], dtype=U) for b in blobs])
    context = np.concatenate([b[1] for b in blobs])
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    new_gram = np.diff(g, prepend=~g[:1]) != 0
    new_context = new_gram | (np.diff(c, prepend=~c[:1]) != 0)
    in_context = np.bincount(np.cumsum(new_context) - 1)[np.cumsum(new_context) - 1]
    bucket = np.cumsum(new_gram) - 1
    contexts = np.bincount(bucket, weights=new_context)[bucket]
    code = np.where(in_context > 1, np.where((contexts > 1) & new_context, SENT_MARKED, MARKED), np.where(contexts > 1, SENT, ALONE))
    out = np.empty(len(order), np.uint8)
    out[order] = code
    return [pack(x) for x in np.split(out, np.cumsum(sizes)[:-1])], None


def _judge_windows(blobs: list[list[np.ndarray]]):
    sizes = [len(b[0]) for b in blobs]
    key = np.concatenate([np.cumsum(b[0], dtype=U) for b in blobs])
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return [pack(x) for x in np.split((count[inverse] > 1).astype(np.uint8), np.cumsum(sizes)[:-1])], None


def _expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All offsets first..last of every run, end to end."""
    n = last - first + 1
    return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _answers(parts: dict[int, bytes], key: np.ndarray, n_parts: int) -> np.ndarray:
    out = np.zeros(len(key), np.uint8)
    for p, where in _by_part((key % U(n_parts)).astype(np.int64), key):
        out[where] = unpack(parts[p])[0]
    return out


def _removed(first: np.ndarray, last: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the bytes covered by windows that start in the given runs."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + length, -1)
    return np.cumsum(step[:n]) > 0


def remove_repeats(docs: DataFrame, length: int = 200, text_column: str = "text", as_text: bool = False, name: str = "repeats") -> DataFrame:
    """Every row of docs with its other columns and `n_bytes`, `n_removed`, `spans`, `kept`.

    A byte is removed if a string of `length` bytes that also starts elsewhere in the corpus (same document included)
    covers it. `spans` lists the maximal removed runs (start, stop), `kept` is the binary rest, or with `as_text` the rest as
    text without characters cut in two. Strings are judged on the
    input. Defined results: NULL text is empty; texts shorter than `length` stay whole; repeated rows are copies of
    each other and lose all but texts under `length`; an empty table gives no rows; NULL ids are kept as they are;
    columns named like the four added ones are replaced.
    """
    spark = prepare(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ADDED]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep])
    chunks = chunked(rows, table_bytes, size=text_column, limit=CHUNK)
    parts = partitions(spark, total_size(chunks))

    def questions(chunk: str, payload: bytes) -> pd.DataFrame:
        found = [Anchors(s, length) for s in _segments(_texts(bytes_table(payload), text_column))]
        found = [f for f in found if len(f.first)]
        if not found:
            return pd.DataFrame({"part": [], "chunk": [], "blob": []})
        gram, context = (np.concatenate([getattr(f, x) for f in found]) for x in ("gram", "context"))
        rows = [(p, chunk, pack(sorted_delta(gram[w]), context[w])) for p, w in _by_part((gram % U(parts)).astype(np.int64), gram)]
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"])

    def anchors(frames):
        for f in giving_back(frames):
            for chunk, payload in zip(f["chunk"], f["payload"], strict=True):
                yield questions(chunk, payload)

    first = ask(chunks.mapInPandas(anchors, "part int, chunk string, blob binary"), _judge_anchors, "anchor", name)

    def judged(payload: bytes, got: dict):
        """Each segment's anchors with their codes, in the order the chunk asked."""
        table = bytes_table(payload)
        texts = _texts(table, text_column)
        found = [Anchors(s, length) for s in _segments(texts)]
        gram = np.concatenate([f.gram for f in found if len(f.first)] or [np.empty(0, U)])
        code = _answers(got.get("anchor", {}), gram, parts) if len(gram) else np.empty(0, np.uint8)
        codes = np.split(code, np.cumsum([len(f.first) for f in found])[:-1]) if found else []
        return table, texts, found, codes

    def sent(found, codes) -> np.ndarray:
        keys = [f.window[_expand(f.first[c >= SENT_MARKED], f.last[c >= SENT_MARKED])] for f, c in zip(found, codes, strict=True) if (c >= SENT_MARKED).any()]
        return np.concatenate(keys) if keys else np.empty(0, U)

    def windows(chunk: str, payload: bytes, got: dict) -> pd.DataFrame:
        _, _, found, codes = judged(payload, got)
        key = sent(found, codes)
        rows = [(p, chunk, pack(sorted_delta(key[w]))) for p, w in _by_part((key % U(parts)).astype(np.int64), key)] if len(key) else []
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"])

    second = ask(with_answers(chunks, first, windows, "part int, chunk string, blob binary"), _judge_windows, "window", name)
    names = [f.name for f in keep]
    extra = f"n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}"
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(extra).fields])

    def decide(chunk: str, payload: bytes, got: dict) -> pd.DataFrame:
        table, texts, found, codes = judged(payload, got)
        key = sent(found, codes)
        again = _answers(got.get("window", {}), key, parts) if len(key) else np.empty(0, np.uint8)
        out, used, doc = [], 0, 0
        for f, code in zip(found, codes, strict=True):
            first, last = f.first[(code == MARKED) | (code == SENT_MARKED)], f.last[(code == MARKED) | (code == SENT_MARKED)]
            single = np.empty(0, np.int64)
            if (code >= SENT_MARKED).any():
                offsets = _expand(f.first[code >= SENT_MARKED], f.last[code >= SENT_MARKED])
                single = offsets[again[used:used + len(offsets)] > 0]
                used += len(offsets)
            gone = _removed(np.append(first, single), np.append(last, single), length, int(f.ends[-1])) if len(f.ends) else np.empty(0, bool)
            at = 0
            for end in f.ends:
                mask = gone[at:end]
                edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                spans = [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]
                kept = texts[doc] if not spans else np.frombuffer(texts[doc], np.uint8)[~mask].tobytes()
                out.append((len(texts[doc]), int(mask.sum()), spans, kept.decode("utf-8", "ignore") if as_text else kept))
                doc, at = doc + 1, end
        frame = table.to_pandas(types_mapper=None, integer_object_nulls=True) if names else pd.DataFrame(index=range(len(out)))
        for i, c in enumerate(ADDED):
            frame[c] = [o[i] for o in out]
        return frame

    return with_answers(chunks, first.unionByName(second), decide, schema)
