"""Per-key building blocks that stay balanced when one key holds a large share of the rows.

Ranking windows are only used under a `rank <= k` filter: Spark then keeps at most k rows of a key per task
*before* the shuffle, so a hot key arrives already reduced. Where every row of a key needs a neighbour or a
number, the key is cut into buckets along its order, solved per bucket, and joined with one row per bucket.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_BROADCAST_ROWS = 200_000


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Long text expressions used by several later filters and columns would otherwise be copied into each of them by the
    optimizer. A generator over a one-element array is a step it does not look through.
    """
    packed = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], packed)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for work that costs far more than moving its input.

    A table in few files or row groups would otherwise be worked on by as few tasks, and partitions sized by bytes would be
    merged although each row takes long.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written to a scratch table and read from there, so that several uses work them out once."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given order; `rank` names a column for the position."""
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (unlike dropDuplicates, which keeps any)."""
    return top_per_key(df, keys, order, 1)


def with_known_size(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting it up to the bound; a larger side is left to a shuffled join."""
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def previous_value(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: Column, into: str,
                   descending: bool = False) -> DataFrame:
    """Add `into`: the nearest earlier non-NULL `value` of the same key (the nearest later one if `descending`).

    `bucket` must not decrease along `order` within a key; its width bounds the rows one task sorts per key.
    """
    def ordered(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    earlier = (Window.unboundedPreceding, -1)
    work = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(ordered(order)).rowsBetween(*earlier)
    near = work.withColumn("__near", F.last("__value", ignorenulls=True).over(inside))
    pick_last = F.min_by if descending else F.max_by
    # one row per bucket: its own edge, and from the window the nearest edge of the buckets before it
    across = Window.partitionBy(*keys).orderBy(ordered("__bucket")).rowsBetween(*earlier)
    reach = (work.groupBy(*keys, "__bucket")
             .agg(pick_last("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__edge"))
             .withColumn("__far", F.last("__edge", ignorenulls=True).over(across)).drop("__edge"))
    return (near.join(reach, [*keys, "__bucket"], "left").withColumn(into, F.coalesce("__near", "__far"))
            .drop("__bucket", "__value", "__near", "__far"))


def next_value(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: Column, into: str) -> DataFrame:
    """Add `into`: the nearest later non-NULL `value` of the same key."""
    return previous_value(df, keys, order, bucket, value, into, descending=True)


def ordinal(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, into: str) -> DataFrame:
    """Number the rows of each key 1, 2, 3… along `order`, bucket by bucket."""
    work = df.withColumn("__bucket", bucket)
    local = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (work.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
               .withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n"))
    return (work.withColumn("__local", local).join(offsets, [*keys, "__bucket"])
            .withColumn(into, F.col("__local") + F.col("__before")).drop("__bucket", "__local", "__before"))
