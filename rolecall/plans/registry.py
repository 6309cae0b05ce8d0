"""Registry of the queries this library ships with, each with the SQL giving the same rows where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (Tables -> DataFrame) under a name, with its SQL."""
    def add(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(configure(spark), folder))
        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


class Tables:
    """The tables of one data folder, read lazily by attribute: t.orders, t.pages."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def pick(values: list, key: Column) -> Column:
    """One of the values, chosen by the row's key: turns a numeric key into feed wording."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def utc(c: Column) -> Column:
    """A timestamp without zone, as the stored tables and the SQL side have it."""
    return c.cast("timestamp_ntz")
