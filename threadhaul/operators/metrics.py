"""Counts, rates and reports of a run, as ordinary aggregations over its log.

Everything here is combined before the shuffle; a hot mailbox or a hot minute
costs one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import id_key, ts_to_unix_ms

RUN_LOG = (
    "run_id string, ts timestamp, event string, mailbox string, items bigint,"
    " bytes_read bigint, bytes_written bigint, note string"
)


def messages_per_page(pages: DataFrame) -> DataFrame:
    """Landed pages with the number of messages in each; the messages are not parsed."""
    count = F.json_array_length(F.get_json_object("body", "$.value"))
    consumed = F.when(F.col("status") == S.STATUS_OK, count)
    return pages.select("mailbox", "page_no", F.coalesce(consumed, F.lit(0)).alias("messages"))


def messages_per_user(pages: DataFrame) -> DataFrame:
    return (
        messages_per_page(pages)
        .groupBy("mailbox")
        .agg(F.sum("messages").alias("messages"), F.count("*").alias("pages"))
    )


def rate_per_window(
    df: DataFrame, ts: str, duration: str, by: Sequence[str] = (), amount: Column | None = None
) -> DataFrame:
    """Items (or the sum of `amount`) per tumbling window, and per second of it."""
    window = F.window(ts, duration)
    counted = F.count("*") if amount is None else F.sum(amount)
    buckets = df.groupBy(window.alias("window"), *by).agg(counted.alias("items"))
    start, end = F.col("window.start"), F.col("window.end")
    seconds = (ts_to_unix_ms(end) - ts_to_unix_ms(start)) / 1000
    return buckets.select(
        *by,
        start.alias("window_start"),
        "items",
        (F.col("items") / seconds).alias("per_second"),
    )


def elapsed_per_user(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Whole milliseconds between the first and the last log row of each user."""
    elapsed = ts_to_unix_ms(F.max(ts)) - ts_to_unix_ms(F.min(ts))
    return df.groupBy(user).agg(elapsed.alias("elapsed_ms"))


def run_totals(log: DataFrame) -> DataFrame:
    """Totals by kind of log row."""
    return log.groupBy("event").agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum("bytes_written"), F.lit(0)).alias("bytes_written"),
    )


def run_summary(log: DataFrame) -> DataFrame:
    """The final report: one row of totals, averages per second, start, end and elapsed time."""
    totals = log.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum("bytes_written"), F.lit(0)).alias("bytes_written"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    ).withColumn(
        "elapsed_ms", ts_to_unix_ms(F.col("ended")) - ts_to_unix_ms(F.col("started"))
    )
    seconds = F.nullif(F.col("elapsed_ms"), F.lit(0).cast("bigint")) / 1000
    return totals.withColumns(
        {
            "items_per_second": F.col("items") / seconds,
            "bytes_read_per_second": F.col("bytes_read") / seconds,
            "bytes_written_per_second": F.col("bytes_written") / seconds,
        }
    )


def id_collisions(messages: DataFrame, mailbox: str, chat_id: str, message_id: str) -> DataFrame:
    """Per chat, how many messages share key 0 because their ids are no numbers.

    Only the first of them can be stored; the others are lost.
    """
    return (
        messages.where(id_key(F.col(message_id)) == 0)
        .groupBy(mailbox, chat_id)
        .agg(F.count("*").alias("same_key"))
        .where(F.col("same_key") > 1)
        .withColumn("lost", F.col("same_key") - 1)
    )


def append_run_log(log: DataFrame, path: str, records: int = S.LOG_RECORDS_PER_FILE) -> None:
    """Append log rows as files of at most `records` rows."""
    log.write.mode("append").option("maxRecordsPerFile", records).parquet(path)
