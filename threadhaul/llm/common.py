"""Sessions, tables and stored intermediates, as the operators of this package use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import configure, scratch, ship_package, stored

# Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20

_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def prepared(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches, and workers that can import this package."""
    configure(spark)
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there."""
    return stored(df, scratch(df.sparkSession, name))


def texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the text of each row, NULL texts as empty ones; other columns go."""
    return df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def first_by_hash(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """A fixed sample of at most `rows` rows: those whose hash of `columns` is smallest.

    Only hashes are sorted; the rows follow by their hash.
    """
    key = F.xxhash64(*columns)
    last = df.select(key.alias("key")).orderBy("key").limit(rows).agg(F.max("key").alias("key")).first().key
    return df.where(key <= last).limit(rows) if last is not None else df.limit(0)
