"""Keyed merges and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import merge
from ..operators.concat import string_concat_agg as concat_rows
from ..operators.dedupe import dedupe_first_wins as first_wins
from ..operators.dedupe import dedupe_last_wins as last_wins
from ..plans.messages import normalize_messages
from ..runtime import scratch
from ..settings import ExportSettings
from ..tables import ChatStore
from .derived import MESSAGE_SQL, SHOWN_SQL, payloads, roster, shown
from .registry import Tables, query

_LAST_ORDER = """SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders"""


@query(f"""SELECT coalesce(s.id, t.id) AS "ExternalDirectoryObjectId",
  CASE WHEN s.id IS NOT NULL THEN s.name ELSE t.name END AS "DisplayName",
  CASE WHEN s.id IS NOT NULL THEN s.mail ELSE t.mail END AS "PrimarySmtpAddress"
FROM (SELECT 'u' || c_custkey AS id, c_name AS name, c_mktsegment || '@sample.com' AS mail
      FROM customer) t
FULL JOIN (SELECT 'u' || o_custkey AS id, o_orderpriority AS name,
             CASE WHEN o_orderstatus <> 'F' THEN 'o' || o_orderkey END AS mail
           FROM ({_LAST_ORDER}) WHERE place = 1
           UNION ALL SELECT 's' || s_suppkey, s_name, NULL FROM supplier) s ON s.id = t.id""")
def merge_upsert(t: Tables):
    """Orders update the customers, the latest one counting; suppliers are new."""
    updates = t.orders.select(
        F.concat(F.lit("u"), "o_custkey").alias("ExternalDirectoryObjectId"),
        F.col("o_orderpriority").alias("DisplayName"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("o"), "o_orderkey")).alias(
            "PrimarySmtpAddress"
        ),
        F.col("o_orderdate").alias("file"),
        F.col("o_orderkey").alias("position"),
    )
    fresh = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("ExternalDirectoryObjectId"),
        F.col("s_name").alias("DisplayName"),
        F.lit(None).cast("string").alias("PrimarySmtpAddress"),
        F.lit(None).cast("timestamp_ntz").alias("file"),
        F.col("s_suppkey").alias("position"),
    )
    return merge.merge_upsert(
        roster(t), updates.unionByName(fresh), S.ROSTER_KEY, ["file", "position"]
    )


@query("""SELECT user_id, event_type, event_id, value FROM events WHERE event_type IN ('view', 'click')
UNION ALL SELECT user_id, event_type, event_id, value + 1 FROM events
WHERE event_type NOT IN ('view', 'click')""")
def merge_insert_only(t: Tables):
    """All events come twice, changed; those stored before stay as they were."""
    columns = ["user_id", "event_type", "event_id", "value"]
    target = t.events.where(F.col("event_type").isin("view", "click")).select(*columns)
    copies = F.explode(F.array(F.lit(1), F.lit(2)))
    source = t.events.withColumn("page_no", copies).withColumn(
        "value", F.col("value") + F.col("page_no")
    )
    new = merge.merge_insert_only(target, source, columns[:3], ["page_no"])
    return target.unionByName(new)


@query(f"""SELECT {SHOWN_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY mailbox, chat_id, id_key
  ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 50 = 7 THEN 1 ELSE 2 END, event_id) AS place FROM ({MESSAGE_SQL})) WHERE place = 1""")
def merge_touched_buckets(t: Tables):
    """Messages merged in three batches, each asking the membership filter: a third of them, a few, and all."""
    place = scratch(t.spark, "database")
    store = ChatStore(
        t.spark, ExportSettings(database=place.rsplit("/", 1)[1].replace("-", "_"), database_location=place, buckets=32)
    )
    store.ensure_tables()
    messages = normalize_messages(payloads(t), "event_id").withColumns(
        {"slice": F.lit(0), "chain_pos": F.lit(0), "position": F.col("event_id")}
    )
    for batch in ("event_id % 3 = 0", "event_id % 50 = 7", "true"):
        store.merge_messages(messages.where(batch))
    return shown(store.read(S.MESSAGE_TABLE))


_RANKED = """SELECT event_id, user_id, event_type, ts, value, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY {order}) AS place FROM events"""
_KEPT = "SELECT event_id, user_id, event_type, ts, value FROM ({ranked}) WHERE place = 1"


@query(_KEPT.format(ranked=_RANKED.format(order="ts DESC, event_id DESC")))
def dedupe_last_wins(t: Tables):
    return last_wins(t.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query(_KEPT.format(ranked=_RANKED.format(order="ts, event_id")))
def dedupe_first_wins(t: Tables):
    return first_wins(t.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier
UNION ALL SELECT c_custkey, c_name FROM customer""")
def dml_append(t: Tables):
    return merge.dml_append(
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    )


@query("""SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN p_name ELSE l_returnflag END AS p_name,
  CASE WHEN l_partkey IS NULL THEN p_retailprice ELSE l_extendedprice END AS p_retailprice
FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey
    ORDER BY l_orderkey DESC, l_linenumber DESC) AS place FROM lineitem) l
  ON l_partkey = p_partkey AND place = 1""")
def dml_update_by_key(t: Tables):
    """Every line changes its part, the last one counting; unknown keys add nothing."""
    changes = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_returnflag").alias("p_name"),
        F.col("l_extendedprice").alias("p_retailprice"),
        "l_orderkey",
        "l_linenumber",
    )
    unknown = t.supplier.select(
        (-F.col("s_suppkey") - 1).alias("p_partkey"),
        F.col("s_name").alias("p_name"),
        F.col("s_acctbal").alias("p_retailprice"),
        F.lit(0).alias("l_orderkey"),
        F.lit(0).alias("l_linenumber"),
    )
    target = t.part.select("p_partkey", "p_name", "p_retailprice")
    return merge.dml_update_by_key(
        target, changes.unionByName(unknown), ["p_partkey"], ["l_orderkey", "l_linenumber"]
    )


@query("""SELECT * FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def dml_delete_by_key(t: Tables):
    doomed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.dml_delete_by_key(t.customer, doomed, ["c_custkey"])


@query("""SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY o_orderpriority) AS joined
FROM orders GROUP BY o_custkey""")
def string_concat_agg(t: Tables):
    return concat_rows(t.orders, ["o_custkey"], "o_orderpriority")


@query("""SELECT user_id, string_agg(v, ';' ORDER BY v) AS joined FROM (SELECT user_id, event_type ||
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ' ' WHEN 3 THEN ';' ELSE 'z' END AS v FROM events) GROUP BY user_id""")
def string_concat_prefixes(t: Tables):
    """Values of which one begins with another, below and above the separator, are joined in their own order."""
    ends = F.get(F.array(*map(F.lit, ("", ":", " ", ";", "z"))), (F.col("event_id") % 5).cast("int"))
    return concat_rows(t.events.select("user_id", F.concat("event_type", ends).alias("v")), ["user_id"], "v")
