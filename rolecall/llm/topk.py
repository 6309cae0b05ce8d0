"""Exact top-k by inner product: an impact-ordered index processed score at a time."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .exchange import pack, prepare, stored, unpack

BLOCK = 16_384
QUERIES = 2_048
SEGMENTS = 16


def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of each dimension in rising order of value: row numbers (dims, n), and their values."""
    order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
    return order, np.take_along_axis(np.ascontiguousarray(values.T), order, 1)


def segments(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of a dimension's segments (equal shares of its postings), and each row's segment in each dimension."""
    dims, n = order.shape
    cuts = np.linspace(0, n, SEGMENTS + 1).astype(np.int64)
    of = np.empty((dims, n), np.uint8)
    number = np.repeat(np.arange(SEGMENTS, dtype=np.uint8), np.diff(cuts))
    for d in range(dims):
        of[d, order[d]] = number
    return cuts, of


def search(query: np.ndarray, values: np.ndarray, order: np.ndarray, ranked: np.ndarray, cuts: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Row numbers that hold the k best for the query, and few others.

    Segments are processed by descending impact, the largest product any of their postings can add over the dimension's
    worst. After a quarter of them the rows ahead are scored exactly; their k-th score is one that the k best reach. From
    then on a row's score so far and the most its unseen dimensions can add bound its score: the search stops when only
    an eighth of the rows can still reach it, or when every segment has been processed.
    """
    n, dims = values.shape
    if n <= 4 * k + 64:
        return np.arange(n)
    low, high = ranked[:, cuts[:-1].clip(max=n - 1)], ranked[:, (cuts[1:] - 1).clip(min=0)]
    up = query >= 0
    upper = np.where(up[:, None], query[:, None] * high, query[:, None] * low)
    worst = np.where(up, query * ranked[:, 0], query * ranked[:, -1])
    # of equal impacts the one next in its dimension's order first, so that what is unseen is always one end of the dimension
    place = np.where(up[:, None], np.arange(SEGMENTS - 1, -1, -1), np.arange(SEGMENTS))
    sequence = np.lexsort((place.ravel(), (worst[:, None] - upper).ravel()))
    at_dim, at_segment = (x.tolist() for x in np.divmod(sequence, SEGMENTS))
    score, left, done = np.zeros(n, np.int64), np.full(dims, SEGMENTS), 0
    floor, starts, factors = None, cuts.tolist(), query.tolist()
    for share in (0.25, 0.35, 0.45, 0.6, 1.0):
        stop = max(1, int(len(sequence) * share)) if share < 1 else len(sequence)
        for d, s in zip(at_dim[done:stop], at_segment[done:stop], strict=True):
            span = slice(starts[s], starts[s + 1])
            score[order[d, span]] += factors[d] * ranked[d, span]
        left -= np.bincount(at_dim[done:stop], minlength=dims)
        done = stop
        if floor is None:
            ahead = np.argpartition(score, n - 4 * k - 1)[n - 4 * k - 1:]
            floor = np.sort(values[ahead] @ query)[-k]
        # segments of a dimension are processed in order, so the next one bounds what is unseen
        coming = np.where(up, left - 1, SEGMENTS - left).clip(0, SEGMENTS - 1)
        bound = np.where(left > 0, upper[np.arange(dims), coming], 0)
        unseen = (of < np.where(up, left, SEGMENTS - left).astype(np.uint8)[:, None]) ^ ~up[:, None]
        rounding = 1 + 1e-5 * float(np.abs(bound).sum())
        open_rows = np.flatnonzero(score + bound.astype(np.float32) @ unseen.astype(np.float32) >= floor - rounding)
        if len(open_rows) <= max(4 * k + 64, n // 8):
            break
    return open_rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products, ties to the smaller vec_id.

    Components become floor(scale * x). Every vector but the query's own id is a candidate. Vectors that are NULL or
    hold NULL or non-finite components take no part, on either side; vectors of different lengths aren't compared; an
    empty vector scores 0; a NULL vec_id takes no part; repeated rows are candidates each (ties among them in any
    order, their output rows are equal); a repeated query id is answered once, as its least vector. Empty tables give no rows.
    Queries meet the index in blocks of both.
    """
    spark = prepare(vectors.sparkSession)
    e = F.col("embedding")

    def whole(df: DataFrame) -> DataFrame:
        finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & finite).select(
            "vec_id", F.transform(e, lambda x: F.floor(scale * x.cast("double"))).alias("e"), F.size(e).alias("width"))

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        table = stored(whole(df), name)
        n = max(1, -(-table.count() // size))
        return table.withColumn("b", F.pmod(F.xxhash64("vec_id", "e"), F.lit(n)).cast("int")), n

    rows, n_blocks = blocks(vectors, BLOCK, "candidates")
    asked, n_asked = blocks(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), QUERIES, "queries")

    def put(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(group["e"].to_numpy()).astype(np.int64).reshape(len(group), -1)
        order, ranked = build(values)
        return pd.DataFrame([(int(group["b"].iloc[0]), int(group["width"].iloc[0]), pack(group["vec_id"].to_numpy(np.int64), values.ravel(), order.ravel(), ranked.ravel()))],
                            columns=["b", "width", "blob"])

    def put_queries(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(group["e"].to_numpy()).astype(np.int64)
        return pd.DataFrame([(int(group["b"].iloc[0]), int(group["width"].iloc[0]), pack(group["vec_id"].to_numpy(np.int64), values.ravel()))], columns=["q", "width", "blob"])

    index = stored(rows.groupBy("b", "width").applyInPandas(put, "b int, width int, blob binary"), "index")
    wanted = stored(asked.groupBy("b", "width").applyInPandas(put_queries, "q int, width int, blob binary"), "asked")
    left = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = wanted.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, values, order, ranked = unpack(a["blob"].iloc[0])
            n = len(ids)
            values, order, ranked = values.reshape(n, -1), order.reshape(-1, n), ranked.reshape(-1, n)
            cuts, of = segments(order)
            order = order.astype(np.intp)
            query_ids, questions = unpack(b["blob"].iloc[0])
            for query_id, query in zip(query_ids, questions.reshape(len(query_ids), -1), strict=True):
                # one more than k for each row of the query's own
                own = int((ids == query_id).sum())
                near = search(query, values, order, ranked, cuts, of, min(n, k + own)) if values.shape[1] else np.arange(n)
                near = near[ids[near] != query_id]
                exact = values[near] @ query
                best = np.lexsort((ids[near], -exact))[:k]
                out += zip([int(query_id)] * len(best), ids[near][best].tolist(), exact[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("b", "q", "width").cogroup(right.groupBy("b", "q", "width")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
