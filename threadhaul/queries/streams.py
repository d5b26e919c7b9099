"""Streaming forms, run over everything available."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import scratch
from ..settings import ExportSettings
from ..sources.pages import explode_pages
from ..streaming.pages import PageStreamExport, for_each_batch, page_stream
from ..streaming.rates import rate_stream
from ..tables import ChatStore
from .derived import MESSAGE_SQL, PAGED_SQL, SHOWN_SQL, event_roster, shown, stored_pages
from .registry import Tables, plain, query


@query(f"SELECT mailbox, page_no, position, message_id AS id FROM ({PAGED_SQL})")
def stream_pages(t: Tables):
    """Landed pages as a stream, exploded batch by batch."""
    out, checkpoint = scratch(t.spark, "exploded"), scratch(t.spark, "checkpoint")

    def handle(pages, batch):
        rows = explode_pages(pages).select(
            "mailbox", "page_no", "position", F.col("message.id").alias("id")
        )
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = page_stream(t.spark, stored_pages(t), max_files=4)
    for_each_batch(stream, checkpoint, handle).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query(f"""SELECT {SHOWN_SQL} FROM (SELECT *, row_number() OVER (
  PARTITION BY mailbox, chat_id, id_key ORDER BY ts, event_id) AS place FROM ({MESSAGE_SQL}))
WHERE place = 1""")
def stream_insert_only(t: Tables):
    """A stream of pages merged into the message table, then all of it again: nothing is added."""
    place = scratch(t.spark, "database")
    settings = ExportSettings(
        start="2023-01-01Z",
        end="2025-01-01Z",
        database=place.rsplit("/", 1)[1].replace("-", "_"),
        database_location=place,
    )
    store = ChatStore(t.spark, settings)
    store.ensure_tables()
    store.upsert_roster(event_roster(t))
    landing = stored_pages(t)
    for _ in range(2):
        export = PageStreamExport(t.spark, settings, scratch(t.spark, "state"))
        export.run(page_stream(t.spark, landing))
    return shown(store.read("UserMessage"))


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
  count(*) AS items, count(*) / 3600.0 AS per_second FROM events GROUP BY ALL""")
def rate_stream_per_window(t: Tables):
    """Rates of a stream; the watermark lets every row of these files in."""
    folder = scratch(t.spark, "log-stream")
    log = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    log.write.parquet(folder)
    stream = t.spark.readStream.schema(log.schema).parquet(folder)
    out, checkpoint = scratch(t.spark, "rates"), scratch(t.spark, "checkpoint")

    def handle(rates, batch):
        rates.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        rate_stream(stream, "ts", "1 hour", "40 days", ["event_type"])
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # Each batch holds the windows that it has changed: the latest counts.
    latest = t.spark.read.parquet(out).groupBy("event_type", "window_start").agg(
        F.max_by("items", "batch").alias("items"), F.max_by("per_second", "batch").alias("per_second")
    )
    return latest.withColumn("window_start", plain(F.col("window_start")))
