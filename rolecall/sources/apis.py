"""Landed answers of public board feeds, and putting the pages of a board together."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import variants as J
from ..operators.keyed import first_per_key
from ..schemas import API_RESPONSES

BOARD = ["domain", "ats", "token"]
PAGE_SIZES = {"workday": 20, "oracle": 50, "smartrecruiters": 100}     # fixed values: what the feeds allow


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(API_RESPONSES).load(path)


def parsed(responses: DataFrame) -> DataFrame:
    """Adds `data`, the parsed body; NULL when the body is no JSON."""
    return responses.withColumn("data", J.parse(F.col("body")))


def newest_pages(pages: DataFrame) -> DataFrame:
    """Each page of a board once: the newest answer where `fetched_at` tells, a readable one before an unreadable one."""
    order = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in pages.columns else []
    return first_per_key(pages, [*BOARD, "page_offset"], [*order, F.col("items").isNull(), F.size("items").desc()])


def _wanted(total: Column, max_jobs: int | None) -> Column:
    return total if max_jobs is None else F.when(total.isNotNull(), F.least(total, F.lit(max_jobs)))


def board_pages(pages: DataFrame, max_jobs: int | None = None, bucket_width: int = 100_000) -> DataFrame:
    """Pages of boards with how many of their rows count: adds wanted (from the first page's total alone) and take.

    pages: domain, ats, token, page_offset, total, items (NULL for an unreadable page), maybe fetched_at. A board is read
    up to its first page's total, or to `max_jobs` if the caller names one. The rows before each page are added up over
    sizes alone, bucket by bucket along the offset; items stay where they are and are joined by page.
    """
    pages = newest_pages(pages)
    place = [*BOARD, "__bucket"]
    bucket = F.floor(F.col("page_offset") / bucket_width)
    sizes = pages.select(*BOARD, "page_offset", bucket.alias("__bucket"), F.coalesce(F.size("items"), F.lit(0)).alias("__size"))
    board = Window.partitionBy(*BOARD).orderBy("__bucket")
    buckets = (sizes.groupBy(*place).agg(F.sum("__size").alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(board.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n"))
    inside = Window.partitionBy(*place).orderBy("page_offset").rowsBetween(Window.unboundedPreceding, -1)
    had = (sizes.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(buckets, place)
           .select(*BOARD, "page_offset", "__size", (F.col("__before") + F.col("__in")).alias("__had")))
    firsts = pages.filter(F.col("page_offset") == 0).select(*BOARD, F.col("total").alias("board_total"))
    wanted = firsts.filter(F.col("board_total").isNotNull()).withColumn("wanted", _wanted(F.col("board_total"), max_jobs))
    numbered = had.join(wanted, BOARD).filter(F.col("page_offset") < F.greatest(F.col("wanted"), F.lit(1)))
    take = F.greatest(F.least(F.col("wanted") - F.col("__had"), F.col("__size")), F.lit(0))
    return pages.join(numbered.withColumn("take", take).drop("__had", "__size"), [*BOARD, "page_offset"])


def board_rows(pages: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """One row per posting of paged boards, in page order: domain, ats, token, page_offset, pos, item."""
    return board_pages(pages, max_jobs).select(
        *BOARD, "page_offset", F.posexplode(F.slice("items", 1, F.col("take").cast("int"))).alias("pos", "item"))


def truncation(pages: DataFrame, page_size: int, max_jobs: int | None = None, unreadable_counts: bool = True) -> DataFrame:
    """Why a board was not read whole, one row per board: capped, or a page that is missing or unreadable; NULL if whole.

    Readable pages after the first are counted per board and compared with how many there should be.
    """
    pages = newest_pages(pages)
    firsts = pages.filter(F.col("page_offset") == 0).select(*BOARD, F.col("total").alias("board_total"))
    firsts = firsts.withColumn("wanted", _wanted(F.col("board_total"), max_jobs))
    later = pages.filter(F.col("items").isNotNull() & (F.col("page_offset") > 0) & (F.col("page_offset") % page_size == 0))
    good = (later.select(*BOARD, "page_offset").join(firsts.select(*BOARD, "wanted"), BOARD).filter(F.col("page_offset") < F.col("wanted"))
            .groupBy(*BOARD).agg(F.count("*").alias("__good")))
    expected = F.greatest(F.ceil(F.col("wanted") / page_size) - 1, F.lit(0))
    unread = F.when(expected > F.coalesce("__good", F.lit(0)), F.lit("a results page could not be read"))
    capped = F.lit(None).cast("string") if max_jobs is None else F.when(F.col("board_total") > max_jobs, F.concat(
        F.lit("board has "), F.col("board_total").cast("string"), F.lit(f" jobs, read {max_jobs}")))
    reason = F.coalesce(unread, capped) if unreadable_counts else capped
    return firsts.join(good, BOARD, "left").select(*BOARD, "board_total", "wanted", reason.alias("truncated"))


def workplace_flags(location: Column) -> Column:
    """hybrid before remote; both flags present and off means on-site; no flags means unknown."""
    hybrid, remote = J.get(location, "hybrid"), J.get(location, "remote")
    return (F.when(J.is_true(hybrid), "hybrid").when(J.is_true(remote), "remote")
            .when(hybrid.isNotNull() | remote.isNotNull(), "onsite"))
