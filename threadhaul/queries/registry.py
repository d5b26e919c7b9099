"""Registration of queries, and access to their tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name; `sql` must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__

        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def text(column: str) -> Column:
    return F.col(column).cast("string")


def plain(column: Column) -> Column:
    """A UTC timestamp without its zone, as SQL engines print it."""
    return column.cast("timestamp_ntz")
