"""Counts, rates and reports over events taken as a run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series_name
from ..operators import metrics as M
from ..operators.moving import warm_start_moving_avg as moving_avg
from ..operators.ordinal import rolling_series
from ..operators.sampling import sampled_rates
from ..runtime import scratch
from .registry import Tables, plain, query

LOG_ROWS = 1000


def _log(t: Tables):
    return t.events.select(
        F.lit("run").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("u"), "user_id").alias("mailbox"),
        F.lit(1).cast("bigint").alias("items"),
        F.octet_length("props").cast("bigint").alias("bytes_read"),
        F.col("event_id").alias("bytes_written"),
        F.col("props").alias("note"),
    )


_HOURLY = """SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
  count(*) AS items FROM events GROUP BY ALL"""


@query(f"SELECT *, items / 3600.0 AS per_second FROM ({_HOURLY})")
def rate_per_window(t: Tables):
    rates = M.rate_per_window(t.events, "ts", "1 hour", ["event_type"])
    return rates.withColumn("window_start", plain(F.col("window_start")))


@query(f"""SELECT event_type, window_start, (sum(items) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  + greatest(10 - row_number() OVER w, 0) * first_value(items) OVER w) / 10.0 AS moving_avg
FROM ({_HOURLY}) WINDOW w AS (PARTITION BY event_type ORDER BY window_start)""")
def warm_start_moving_avg(t: Tables):
    rates = M.rate_per_window(t.events, "ts", "1 hour", ["event_type"])
    averaged = moving_avg(rates, ["event_type"], ["window_start"], "items", chunk_rows=200)
    return averaged.select(
        "event_type", plain(F.col("window_start")).alias("window_start"), "moving_avg"
    )


@query("""WITH RECURSIVE c AS (SELECT event_type, min(ts) AS closed_at, CAST(NULL AS TIMESTAMP) AS begun FROM events GROUP BY event_type
  UNION ALL SELECT event_type, next, closed_at FROM (SELECT c.event_type, c.closed_at, (SELECT min(ts) FROM events e
    WHERE e.event_type = c.event_type AND e.ts >= c.closed_at + INTERVAL 1 HOUR) AS next FROM c) WHERE next IS NOT NULL),
f AS (SELECT event_type, min(ts) AS first FROM events GROUP BY event_type),
r AS (SELECT c.event_type, c.closed_at, count(*) AS items, (epoch_us(c.closed_at) - epoch_us(c.begun)) / 1000.0 AS elapsed_ms
  FROM c JOIN f USING (event_type) JOIN events e ON e.event_type = c.event_type AND e.ts <= c.closed_at
    AND (e.ts > c.begun OR c.begun = first) WHERE c.begun IS NOT NULL GROUP BY ALL),
s AS (SELECT *, items / elapsed_ms * 1000.0 AS per_second FROM r)
SELECT *, (sum(per_second) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  + greatest(10 - row_number() OVER w, 0) * first_value(per_second) OVER w) / 10.0 AS moving_avg
FROM s WINDOW w AS (PARTITION BY event_type ORDER BY closed_at)""")
def sampled_rate(t: Tables):
    """Rates over intervals that events close, at least an hour after the last close, and the mean of the last ten."""
    rates = sampled_rates(t.events, "ts", ["event_type"], least_ms=3_600_000, chunk=24)
    averaged = moving_avg(rates, ["event_type"], ["closed_at"], "per_second")
    return averaged.withColumn("closed_at", plain(F.col("closed_at")))


@query("""SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS elapsed_ms
FROM events GROUP BY user_id""")
def elapsed_per_user(t: Tables):
    return M.elapsed_per_user(t.events, "user_id", "ts")


@query("""SELECT event_type AS event, count(*) AS entries, count(*) AS items,
  sum(strlen(props)) AS bytes_read, sum(event_id) AS bytes_written FROM events GROUP BY event_type""")
def run_totals(t: Tables):
    return M.run_totals(_log(t))


@query("""SELECT *, items / (elapsed_ms / 1000.0) AS items_per_second,
  bytes_read / (elapsed_ms / 1000.0) AS bytes_read_per_second,
  bytes_written / (elapsed_ms / 1000.0) AS bytes_written_per_second
FROM (SELECT count(*) AS items, sum(strlen(props)) AS bytes_read, sum(event_id) AS bytes_written,
  min(ts) AS started, max(ts) AS ended,
  epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS elapsed_ms FROM events)""")
def run_summary(t: Tables):
    summary = M.run_summary(_log(t))
    return summary.withColumns(
        {"started": plain(F.col("started")), "ended": plain(F.col("ended"))}
    )


@query("""SELECT event_type AS event, count(*) AS entries, true AS small_files
FROM events GROUP BY event_type""")
def run_log_append(t: Tables):
    """The log appended in two goes and read back; no file is over its limit."""
    path = scratch(t.spark, "log")
    log = _log(t)
    M.append_run_log(log.where("event IN ('view', 'click')"), path, LOG_ROWS)
    M.append_run_log(log.where("event NOT IN ('view', 'click')"), path, LOG_ROWS)
    per_file = t.spark.read.parquet(path).groupBy(
        F.col("_metadata.file_path").alias("file"), "event"
    ).count()
    sizes = per_file.groupBy("file").agg(F.sum("count").alias("rows"))
    return (
        per_file.join(sizes, "file")
        .groupBy("event")
        .agg(
            F.sum("count").alias("entries"),
            F.bool_and(F.col("rows") <= LOG_ROWS).alias("small_files"),
        )
    )


@query(f"""SELECT event_id, CASE WHEN n = 0 THEN 'logfile.log' ELSE 'logfile_' || n || '.log' END AS file
FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // {LOG_ROWS} AS n FROM events)""")
def rolling_series_name(t: Tables):
    numbered = rolling_series(t.events.select("event_id", "ts"), ["ts", "event_id"], LOG_ROWS)
    return numbered.select("event_id", series_name("logfile.log", F.col("series")).alias("file"))


@query("""SELECT user_id, event_type, count(*) AS same_key, count(*) - 1 AS lost
FROM events WHERE event_id % 11 = 0 OR event_id = 0 GROUP BY ALL HAVING count(*) > 1""")
def id_collisions(t: Tables):
    """Messages of a chat that share a key because their ids are no numbers."""
    given = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("m"), "event_id")).otherwise(
        F.col("event_id").cast("string")
    )
    rows = t.events.withColumn("message_id", given)
    return M.id_collisions(rows, "user_id", "event_type", "message_id")

