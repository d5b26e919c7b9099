"""Worklist, progress, lookups and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse_bound
from ..operators import filters
from ..operators import worklist as W
from ..operators.sqltext import parametrized_sql as run_sql
from ..operators.sqltext import scalar_datetime as first_datetime
from ..operators.sqltext import scalar_int as first_int
from .derived import progress, roster
from .registry import Tables, plain, query

_ROSTER_SQL = """(SELECT c_name AS "DisplayName", 'u' || c_custkey AS "ExternalDirectoryObjectId",
  c_mktsegment || '@sample.com' AS "PrimarySmtpAddress", c_custkey FROM customer)"""
_DONE_SQL = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'"


@query(f"""SELECT "DisplayName", "ExternalDirectoryObjectId", "PrimarySmtpAddress"
FROM {_ROSTER_SQL} WHERE NOT EXISTS ({_DONE_SQL})""")
def resume_worklist(t: Tables):
    return W.resume_worklist(roster(t), progress(t))


@query(f"SELECT count(*) AS pending FROM {_ROSTER_SQL} WHERE NOT EXISTS ({_DONE_SQL})")
def pending_count(t: Tables):
    return W.pending_count(roster(t), progress(t))


@query(f"""SELECT avg(CASE WHEN EXISTS ({_DONE_SQL}) THEN 1.0 ELSE 0.0 END) AS ratio,
  count(*) FILTER (EXISTS ({_DONE_SQL})) AS finished, count(*) AS total FROM customer""")
def progress_ratio(t: Tables):
    return W.progress_ratio(roster(t), progress(t))


@query("SELECT CAST(0 AS BIGINT) AS pending")
def resume_second_run(t: Tables):
    """After the worklist has been committed nothing is pending."""
    todo = W.resume_worklist(roster(t), progress(t))
    done = W.progress_commit(progress(t), todo, "ExternalDirectoryObjectId")
    return W.pending_count(roster(t), progress(t).unionByName(done))


@query("""SELECT type, value FROM (
  SELECT 'user' AS type, 'u' || c_custkey AS value FROM customer
  UNION SELECT CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'other' END, 'u' || o_custkey
  FROM orders)""")
def progress_commit(t: Tables):
    known = progress(t).distinct()
    return known.unionByName(
        W.progress_commit(known, roster(t), "ExternalDirectoryObjectId")
    )


@query("""SELECT event_id, ts FROM events
WHERE ts > TIMESTAMP '2024-01-05' AND ts < (SELECT max(ts) FROM events)""")
def time_window_filter(t: Tables):
    """From a bound as users write it up to, and without, the last event."""
    last = t.events.agg(F.max("ts").alias("ts")).first()["ts"]
    start = plain(parse_bound(F.lit("2024-01-05Z")))
    end = F.lit(last.isoformat(sep=" ")).cast("timestamp_ntz")
    return filters.time_window_filter(t.events, "ts", start, end).select("event_id", "ts")


@query("""SELECT doc_id, "key" FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL
  WHEN n_chars < 500 THEN '' ELSE source END AS "key" FROM documents)
WHERE "key" IS NOT NULL AND "key" <> ''""")
def filter_null_or_empty(t: Tables):
    key = F.when(F.col("lang") == "fr", None).when(F.col("n_chars") < 500, "").otherwise(
        F.col("source")
    )
    return filters.filter_null_or_empty(t.documents.select("doc_id", key.alias("key")), "key")


@query("""SELECT doc_id, CASE WHEN source IS NULL OR n_chars < 300 THEN 'mailbox'
  WHEN lang = 'fr' THEN 'chatId' WHEN n_chars > 5000 THEN 'id' END AS problem FROM documents""")
def validate_messages(t: Tables):
    """Short documents lack a mailbox, French ones a chat, long ones an id."""
    size = F.col("n_chars")
    rows = t.documents.select(
        "doc_id",
        F.when(size < 300, "").otherwise(F.col("source")).alias("mailbox"),
        F.when(F.col("lang") != "fr", "").alias("chat"),
        F.when(size <= 5000, "").alias("message"),
    )
    return filters.validate_messages(rows, "mailbox", "chat", "message").select("doc_id", "problem")


@query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AND o_orderstatus = 'F'")
def lookup_by_keys(t: Tables):
    keys = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    found = filters.lookup_by_keys(t.orders, keys, ["o_custkey", "o_orderstatus"])
    return found.select(*t.orders.columns)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def find_all(t: Tables):
    return filters.find_all(t.orders, F.col("o_totalprice") > 200000, "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderkey LIMIT 1""")
def find_first(t: Tables):
    return filters.find_first(
        t.orders,
        ["o_orderkey"],
        F.col("o_orderstatus") == "F",
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
    )


@query("""SELECT 'expensive' AS query, count(*) AS value FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'none', 0""")
def scalar_int(t: Tables):
    expensive = run_sql(
        t.spark,
        "SELECT count(*) FROM {orders} WHERE o_totalprice > :low",
        {"low": 200000},
        orders=t.orders,
    )
    none = t.orders.where("o_totalprice < 0").select("o_orderkey")
    return (
        first_int(expensive)
        .select(F.lit("expensive").alias("query"), "value")
        .unionByName(first_int(none).select(F.lit("none").alias("query"), "value"))
    )


@query("""SELECT 'last' AS query, max(o_orderdate) AS value FROM orders
UNION ALL SELECT 'none', NULL""")
def scalar_datetime(t: Tables):
    last = run_sql(t.spark, "SELECT max(o_orderdate) FROM {orders}", orders=t.orders)
    none = t.orders.where("o_totalprice < 0").select("o_orderdate")
    rows = first_datetime(last).select(F.lit("last").alias("query"), "value").unionByName(
        first_datetime(none).select(F.lit("none").alias("query"), "value")
    )
    return rows.withColumn("value", plain(F.col("value")))


@query("""SELECT o_orderpriority, count(*) AS orders FROM orders
WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_orderpriority""")
def parametrized_sql(t: Tables):
    return run_sql(
        t.spark,
        """SELECT o_orderpriority, count(*) AS orders FROM {orders}
        WHERE o_totalprice > :low AND o_orderstatus = :status GROUP BY o_orderpriority""",
        {"low": 100000, "status": "F"},
        orders=t.orders,
    )
