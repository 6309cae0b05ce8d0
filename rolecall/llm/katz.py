"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts, fitted and applied in hash partitions.

Documents are tokenised once and stored as chunks of word numbers. Three rounds of questions follow (see exchange.py):
words (how often is each in training, and its number), pairs (how often does each word pair occur), histories (how much
probability does each word leave to pairs not seen after it). Rounds are stored tables partitioned by the hash of the
word, or of the pair where its first word is so common that one partition would hold too many; no table of the model
is ever in one task or on the driver, which only gets sums (tokens, types, and how many pairs occur 1 to 6 times).

P(w | v) = d(r) r / den(v) for a pair seen r times in training, else alpha(v) P(w), evaluated for every token. d(r) is Katz's
Good-Turing discount for r up to 5 and 1 above; den(v) is the number of times v precedes a token, plus 1 if no discount
leaves mass; alpha(v) makes the probabilities after v sum to one over the vocabulary and one unknown word exactly.
P(w) = (c + 0.1) / (N + 0.1 (V + 1)), which itself sums to one.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import ask, bytes_table, chunked, crc_of_id_value, pack, partitions, prepare, stored, table_bytes, total_size, unpack, with_answers

END, START = b"", b"\t"  # no word is empty or holds white space
SEPARATOR = b"\n"
KEEP = 5
CHUNK = 24_000_000
ADD = 0.1


def _encode(held_out_mod: int):
    """Chunk of documents -> word list, word numbers of all tokens, tokens per document, training flags, ids."""
    def encode(table: pa.Table) -> bytes:
        docs = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in table.column("text").to_pylist()]
        counts = Counter()
        for d in docs:
            counts.update(d)
        words = [END, START, *sorted(counts, key=lambda w: (-counts[w], w))]
        number = {w: i for i, w in enumerate(words)}
        ids = np.fromiter((i for d in docs for i in (*map(number.__getitem__, d), 0)), np.int32, sum(map(len, docs)) + len(docs))
        held = np.array([crc_of_id_value(i) % held_out_mod == 0 for i in table.column("doc_id").to_pylist()], np.uint8)
        tokens = pack(np.frombuffer(SEPARATOR.join(words[2:]), np.uint8), ids, np.array([len(d) + 1 for d in docs], np.int64), held)
        return len(tokens).to_bytes(8, "little") + tokens + table_bytes(table.select(["doc_id"]))
    return encode


def _decode(payload: bytes):
    n = int.from_bytes(payload[:8], "little")
    raw, ids, lengths, held = unpack(payload[8:8 + n])
    words = [END, START, *(raw.tobytes().split(SEPARATOR) if len(raw) else [])]
    return words, ids, lengths, held.astype(bool), bytes_table(payload[8 + n:])


def _split(part: np.ndarray):
    """(part number, positions) of each part, positions in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(part[order[lo]]), order[lo:hi]


def _word_parts(words: list[bytes], parts: int):
    """Positions of a chunk's words for each part, in the words' byte order (so that they compress)."""
    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    for p, at in _split(part):
        yield p, np.array(sorted(at.tolist(), key=words.__getitem__))


def _histories(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the word before each token; 1 (START) at the beginning of a document."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(ids):
        before[np.cumsum(lengths) - lengths] = 1
    return before


def _answer_words(parts: int):
    def answer(blobs):
        asked = [b[0].tobytes().split(SEPARATOR) for b in blobs]
        total = Counter()
        for words, b in zip(asked, blobs, strict=True):
            for w, n in zip(words, b[1].tolist(), strict=True):
                total[w] += n
        number = {w: i for i, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}
        replies = [pack(np.array([number[w] for w in words], np.int64), np.array([total[w] for w in words], np.int64)) for words in asked]
        counted = [n for n in total.values() if n]
        return replies, pack(np.array([sum(counted), len(counted)], np.int64))
    return answer


def _answer_pairs(unigram, parts: int):
    """Counts of asked pairs; summary: how many pairs occur 1..6 times, and sums for each first word."""
    def answer(blobs):
        sizes = [len(b[2]) for b in blobs]
        v = np.concatenate([np.repeat(np.cumsum(b[0]), b[1]) for b in blobs])
        w, n, c = (np.concatenate([b[i] for b in blobs]) for i in (2, 3, 4))
        order = np.lexsort((w, v))
        new = (np.diff(v[order], prepend=-1) != 0) | (np.diff(w[order], prepend=-1) != 0)
        group = np.cumsum(new) - 1
        sums = np.bincount(group, weights=n[order]).astype(np.int64)
        out = np.empty(len(order), np.int64)
        out[order] = sums[group]
        first = order[new]
        seen = sums > 0
        r, hv, pw = sums[seen], v[first][seen], unigram(c[first][seen])
        starts = np.flatnonzero(np.diff(hv, prepend=-1))
        stats = [hv[starts]]
        for k in range(1, KEEP + 1):
            stats.append(np.add.reduceat((r == k).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64))
        stats.append(np.add.reduceat(np.where(r > KEEP, r, 0), starts) if len(starts) else np.empty(0, np.int64))
        stats.append(np.add.reduceat(pw, starts) if len(starts) else np.empty(0))
        of = np.bincount(np.minimum(r, KEEP + 2), minlength=KEEP + 3)[1:KEEP + 2].astype(np.int64)
        return [pack(x) for x in np.split(out, np.cumsum(sizes)[:-1])], pack(of, *stats)
    return answer


def discounts(of: list[int]) -> np.ndarray:
    """d(0..KEEP) from how many pairs occur 1..KEEP + 1 times.

    Where Good-Turing gives nothing between 0 and 1 (too few counts), half a count is taken off.
    """
    d = np.ones(KEEP + 1)
    tail = (KEEP + 1) * of[KEEP] / of[0] if of[0] else 1.0
    for r in range(1, KEEP + 1):
        good = ((r + 1) * of[r] / (r * of[r - 1]) - tail) / (1 - tail) if of[r - 1] and tail < 1 else -1.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def backoff(counts: np.ndarray, big: np.ndarray, seen_mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(den, alpha) of histories from their numbers of pairs seen 1..KEEP times, the rest's sum, and the P of all seen after them."""
    r = np.arange(1, KEEP + 1)
    total = (counts * r).sum(axis=1) + big
    kept = (counts * (r * d[1:])).sum(axis=1) + big
    den = np.where(total - kept > 1e-9, total, total + 1).astype(np.float64)
    return den, (1 - kept / den) / np.maximum(1 - seen_mass, 1e-300)


def katz_scores(docs: DataFrame, held_out_mod: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id is divisible by held_out_mod are scored only. score is the model's log10 probability of the
    text, base_score that of P(w) alone. Defined results: NULL and empty texts are the one token "end"; a NULL doc_id
    counts as the empty id text; repeated rows are trained on and scored each; with no training text every token is unknown
    (N = V = 0); an empty table gives no rows; further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    chunks = chunked(docs.select("doc_id", "text"), _encode(held_out_mod), limit=CHUNK)
    parts = partitions(spark, total_size(chunks), 8_000_000)
    asks = "part int, chunk string, blob binary"

    def ask_words(frames):
        for f in frames:
            for chunk, payload in zip(f["chunk"], f["payload"], strict=True):
                words, ids, lengths, held, _ = _decode(payload)
                n = np.bincount(ids[~np.repeat(held, lengths)], minlength=len(words))
                yield pd.DataFrame([(p, chunk, pack(np.frombuffer(SEPARATOR.join(words[i] for i in at), np.uint8), n[at])) for p, at in _word_parts(words, parts)],
                                   columns=["part", "chunk", "blob"])

    first = ask(chunks.mapInPandas(ask_words, asks), _answer_words(parts), "word", "words")

    def numbers(frames):
        for f in frames:
            yield pd.DataFrame([unpack(b)[0].tolist() for b in f["blob"]], columns=["n", "v"]).astype("int64")

    n_train, n_types = first.filter("chunk is null").select("blob").mapInPandas(numbers, "n bigint, v bigint").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).head()

    def unigram(c: np.ndarray) -> np.ndarray:
        return (c + ADD) / (n_train + ADD * (n_types + 1))

    common = max(1, n_train // (8 * parts))

    def word_answers(words: list[bytes], got: dict[int, bytes]):
        gid, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for p, at in _word_parts(words, parts):
            local, count[at] = unpack(got[p])
            gid[at] = local * parts + p
        return gid, count

    def pair_parts(words, ids, lengths, held, gid, count):
        """Distinct pairs of the chunk (by chunk word numbers), their training counts, and for each part their positions."""
        before = _histories(ids, lengths)
        key, inverse = np.unique(before.astype(np.int64) * len(words) + ids, return_inverse=True)
        v, w = np.divmod(key, len(words))
        n = np.bincount(inverse[~np.repeat(held, lengths)], minlength=len(key))
        gv, gw = gid[v], gid[w]
        spread = (count[v] > common) | (v == 1)
        mixed = (gv * 0x9E3779B1 + np.where(spread, gw * 0x85EBCA77, 0)) & 0x7FFFFFFFFFFFFFFF
        mixed ^= mixed >> 29
        order = np.lexsort((gw, gv))
        return inverse, v, w, n, gv, gw, [(p, order[at]) for p, at in _split((mixed % parts)[order])]

    def ask_pairs(chunk, payload, got):
        words, ids, lengths, held, _ = _decode(payload)
        gid, count = word_answers(words, got["word"])
        _, _, w, n, gv, gw, where = pair_parts(words, ids, lengths, held, gid, count)
        rows = []
        for p, at in where:
            cuts = np.flatnonzero(np.diff(gv[at], prepend=-1))
            rows.append((p, chunk, pack(np.diff(gv[at][cuts], prepend=0), np.diff(np.append(cuts, len(at))), gw[at], n[at], count[w[at]])))
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"])

    second = ask(with_answers(chunks, first, ask_pairs, asks), _answer_pairs(unigram, parts), "pair", "pairs")

    def spread_sums(frames):
        """Each pair partition's sums, to the partitions of the words they are about; counts of counts beside them."""
        for f in frames:
            for blob in f["blob"]:
                of, hv, *stats = unpack(blob)
                yield pd.DataFrame([(-1, None, "of", pack(of))] + [(p, None, "sums", pack(hv[at] // parts, *[s[at] for s in stats])) for p, at in _split(hv % parts)],
                                   columns=["part", "chunk", "kind", "blob"])

    sums = stored(second.filter("chunk is null").select("blob").mapInPandas(spread_sums, "part int, chunk string, kind string, blob binary"), "sums")

    def of_counts(frames):
        for f in frames:
            yield pd.DataFrame([unpack(b)[0].tolist() for b in f["blob"]], columns=[f"n{i}" for i in range(1, KEEP + 2)]).astype("int64")

    names = [f"n{i}" for i in range(1, KEEP + 2)]
    of = sums.filter("kind = 'of'").select("blob").mapInPandas(of_counts, ", ".join(f"{n} bigint" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).head()
    d = discounts(list(of))

    def histories(group: pd.DataFrame) -> pd.DataFrame:
        mine = [unpack(b) for b in group.loc[group["kind"] == "sums", "blob"]]
        asked = group[group["kind"] == "word"].sort_values("chunk")
        gids = [unpack(b)[0] for b in asked["blob"]]
        size = max([0, *(int(g.max()) + 1 for g in gids if len(g)), *(int(m[0].max()) + 1 for m in mine if len(m[0]))])
        counts, big, mass = np.zeros((size, KEEP)), np.zeros(size), np.zeros(size)
        for m in mine:
            for k in range(KEEP):
                np.add.at(counts[:, k], m[0], m[1 + k])
            np.add.at(big, m[0], m[1 + KEEP])
            np.add.at(mass, m[0], m[2 + KEEP])
        den, alpha = backoff(counts, big, mass, d)
        den, alpha = np.where(counts.sum(axis=1) + big > 0, den, 0.0), np.where(counts.sum(axis=1) + big > 0, alpha, 1.0)
        return pd.DataFrame({"chunk": asked["chunk"], "kind": "history", "part": asked["part"], "blob": [pack(den[g], alpha[g]) for g in gids]})

    third = stored(first.filter("chunk is not null").select("part", "chunk", "kind", "blob").unionByName(sums.filter("kind = 'sums'"))
                   .groupBy("part").applyInPandas(histories, "chunk string, kind string, part int, blob binary"), "histories")

    def score(chunk, payload, got):
        words, ids, lengths, held, table = _decode(payload)
        gid, count = word_answers(words, got["word"])
        inverse, v, w, _, _, _, where = pair_parts(words, ids, lengths, held, gid, count)
        r = np.empty(len(v), np.int64)
        for p, at in where:
            r[at] = unpack(got["pair"][p])[0]
        den, alpha = np.empty(len(words)), np.empty(len(words))
        for p, at in _word_parts(words, parts):
            den[at], alpha[at] = unpack(got["history"][p])
        uni = np.log10(unigram(count))
        seen = r > 0
        logs = np.empty(len(v))
        logs[seen] = np.log10(d[np.where(r[seen] > KEEP, 0, r[seen])] * r[seen] / den[v[seen]])
        logs[~seen] = np.log10(alpha[v[~seen]]) + uni[w[~seen]]
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0)
        return pd.DataFrame({"doc_id": table.column("doc_id").to_pandas(integer_object_nulls=True), "held_out": held, "n_tokens": lengths, "n_known": add((count[ids] > 0).astype(np.int64)),
                             "train_tokens": n_train, "base_score": add(uni[ids]), "score": add(logs[inverse])})

    answers = first.unionByName(second).unionByName(third)
    return with_answers(chunks, answers, score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
