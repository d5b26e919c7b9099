"""Pages: numbering, parsing, judging and fetching."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import chain
from ..operators.metrics import messages_per_user as per_user
from ..operators.ordinal import paginate as number_pages
from ..plans.export import ChatExport, landed_pages_reader
from ..runtime import scratch, stored
from ..settings import ExportSettings
from ..sources import pages as P
from ..sources.paged import deal_by_size
from ..streaming.pages import PageStreamExport, page_stream
from .derived import (
    MESSAGE_SQL,
    PAGE_ROWS,
    PAGED_SQL,
    SHOWN_SQL,
    event_roster,
    judged_page_sql,
    landed_pages,
    progress,
    responses,
    roster,
    shown,
    stored_pages,
)
from .registry import Tables, query, text

WINDOW = ("2024-01-05T00:00:00", "2024-01-25T00:00:00")


@query(f"""SELECT event_id, (n - 1) // {PAGE_ROWS} AS page_no, (n - 1) % {PAGE_ROWS} AS position
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def paginate(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts")
    return number_pages(rows, "user_id", ["ts", "event_id"], PAGE_ROWS).select(
        "event_id", "page_no", "position"
    )


@query(f"SELECT mailbox, page_no, position, message_id AS id, chat_id AS chat FROM ({PAGED_SQL})")
def explode_pages(t: Tables):
    return P.explode_pages(landed_pages(t)).select(
        "mailbox",
        "page_no",
        "position",
        F.col("message.id").alias("id"),
        F.col("message.chatId").alias("chat"),
    )


@query(f"""SELECT mailbox, count(*) AS messages, count(DISTINCT page_no) AS pages
FROM ({PAGED_SQL}) GROUP BY mailbox""")
def messages_per_user(t: Tables):
    return per_user(landed_pages(t))


@query("""SELECT 'u' || c_custkey AS mailbox, c_name AS name, c_acctbal AS balance FROM customer
WHERE c_acctbal >= 0""")
def parse_single_doc(t: Tables):
    """One document per customer; those in debt are forbidden."""
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    answers = t.customer.select(
        F.concat(F.lit("u"), text("c_custkey")).alias("mailbox"),
        F.when(F.col("c_acctbal") < 0, 403).otherwise(200).alias("status"),
        body.alias("body"),
    )
    return P.parse_single_doc(answers, "struct<name string, balance double>").select(
        "mailbox", "document.name", "document.balance"
    )


@query(f"SELECT mailbox, page_no, status, disposition FROM ({judged_page_sql()})")
def classify_status(t: Tables):
    disposition = chain.classify_status(F.col("status"), F.col("model"))
    return responses(t).select("mailbox", "page_no", "status", disposition.alias("disposition"))


_PREFIX_SQL = f"""SELECT *, coalesce(sum(CASE WHEN terminal THEN 1 ELSE 0 END) OVER (
  PARTITION BY mailbox ORDER BY chain_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
  coalesce(sum(CASE WHEN disposition <> 'consume' THEN 1 ELSE 0 END) OVER (
  PARTITION BY mailbox ORDER BY chain_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps
FROM ({judged_page_sql()})"""


@query(f"SELECT mailbox, page_no, disposition FROM ({_PREFIX_SQL}) WHERE ended = 0")
def page_chain_prefix(t: Tables):
    return chain.page_chain_prefix(responses(t)).select("mailbox", "page_no", "disposition")


@query(f"""SELECT mailbox, CASE disposition WHEN 'consume' THEN 'complete' ELSE 'skipped' END AS outcome
FROM ({_PREFIX_SQL}) WHERE ended = 0 AND terminal AND disposition IN ('consume', 'skip') AND gaps = 0""")
def completed_users(t: Tables):
    """Mailboxes whose chain has ended; a page that was refused and not asked for again is a gap."""
    return chain.completed_users(chain.chain_outcomes(chain.with_disposition(responses(t))))


@query(f"""SELECT mailbox, message_id AS id FROM ({MESSAGE_SQL})
WHERE ts > TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'""")
def paged_source(t: Tables):
    """The landed pages of the users on a worklist, their messages cut to the window."""
    users = t.events.select(F.concat(F.lit("u"), "user_id").alias("mailbox")).distinct()
    pages = landed_pages_reader(t.spark.read.parquet(stored_pages(t)))(users)
    window = tuple(datetime.fromisoformat(bound) for bound in WINDOW)
    return P.explode_pages(pages, window=window).select("mailbox", F.col("message.id").alias("id"))


_TASKS = 16


@query(f"""SELECT mailbox, slices, CAST(slice AS INT) AS slice, size / slices AS size, true AS fits FROM (
  SELECT mailbox, size, greatest(1, CAST(ceil(size * 3 * {_TASKS} / sum(size) OVER ()) AS INT)) AS slices FROM (
    SELECT 'u' || user_id AS mailbox, CAST(count(*) AS DOUBLE) AS size FROM (
      SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id FROM events) GROUP BY user_id)), LATERAL (SELECT unnest(range(slices)) AS slice)""")
def chains_by_size(t: Tables):
    """Chains dealt to tasks by the messages of an earlier run, a third of which one user has: no task is a third above the mean."""
    user = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    sizes = t.events.groupBy(F.concat(F.lit("u"), user).alias("mailbox")).agg(F.count("*").cast("double").alias("size"))
    chains = stored(deal_by_size(sizes, _TASKS), scratch(t.spark, "chains"))
    loads = chains.groupBy("task").agg(F.sum("size").alias("load"))
    mean = chains.agg((F.sum("size") / _TASKS).alias("mean"))
    fits = loads.select("task", (F.col("load") <= F.lit(4 / 3) * mean.scalar() + 1e-6).alias("fits"))
    return chains.join(fits, "task").select("mailbox", "slices", "slice", "size", "fits")


def _roster_folder(t: Tables) -> str:
    path = scratch(t.spark, "roster")
    group = F.call_function("div", F.col("n"), F.lit(500))
    numbered = roster(t).withColumn(
        "n", F.substring("ExternalDirectoryObjectId", 2, 20).cast("bigint")
    )
    (
        numbered.groupBy(group.alias("AllMailBoxes"))
        .agg(
            F.to_json(
                F.collect_list(
                    F.struct("DisplayName", "ExternalDirectoryObjectId", "PrimarySmtpAddress")
                )
            )
        )
        .write.partitionBy("AllMailBoxes")
        .text(path)
    )
    return path


_PENDING_SQL = f"""SELECT *, row_number() OVER (PARTITION BY mailbox, chat_id, id_key
    ORDER BY ts, event_id) AS place
  FROM ({MESSAGE_SQL}) WHERE ts > TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderstatus = 'F')"""


def _export(t: Tables) -> ChatExport:
    """An export with the customers as roster, finished orders as progress, events as messages."""
    place = scratch(t.spark, "database")
    settings = ExportSettings(
        start=WINDOW[0],
        end=WINDOW[1],
        roster_pattern="AllMailBoxes*.txt",
        database=place.rsplit("/", 1)[1].replace("-", "_"),
        database_location=place,
    )
    export = ChatExport(t.spark, settings)
    export.store.ensure_tables()
    export.store.set_version()
    done = progress(t).where("type = 'user'").select("value").distinct()
    export.store.commit_progress(done, "value")
    return export


@query(f"SELECT {SHOWN_SQL} FROM ({_PENDING_SQL}) WHERE place = 1")
def export_run(t: Tables):
    """The whole export: roster files and landed pages to stored messages."""
    export = _export(t)
    export.run(_roster_folder(t), landed_pages_reader(t.spark.read.parquet(stored_pages(t))))
    return shown(export.store.read("UserMessage"))


def _with_empty_pages(t: Tables, pages: DataFrame) -> DataFrame:
    """Pages, and one without messages for each user of the roster that has none."""
    silent = roster(t).select(F.col("ExternalDirectoryObjectId").alias("mailbox")).join(pages, "mailbox", "left_anti")
    empty = silent.select(
        "mailbox",
        F.lit(0).alias("page_no"),
        F.lit(200).alias("status"),
        F.lit("A").alias("model"),
        F.lit(None).cast("string").alias("next_link"),
        F.lit('{"value":[]}').alias("body"),
    )
    return pages.unionByName(empty)


@query(f"""SELECT count(*) FILTER (place = 1) AS messages, CAST(0 AS BIGINT) AS pending,
  CAST(0 AS BIGINT) AS inserted,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer
     UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS finished
FROM ({_PENDING_SQL})""")
def export_resume(t: Tables):
    """A second run finds an empty worklist; users without messages are done too."""
    export = _export(t)
    reader = landed_pages_reader(_with_empty_pages(t, t.spark.read.parquet(stored_pages(t))))
    export.run(_roster_folder(t), reader)
    again = export.run(None, reader)
    store = export.store
    finished = store.read("GraphCallProcessed").agg(F.count("*")).scalar()
    return store.read("UserMessage").agg(
        F.count("*").alias("messages"),
        F.lit(again.pending).cast("bigint").alias("pending"),
        F.lit(again.inserted).cast("bigint").alias("inserted"),
        F.any_value(finished).alias("finished"),
    )


@query(f"""SELECT (SELECT count(*) FROM ({_PENDING_SQL}) WHERE place = 1 AND user_id % 7 <> 3
    AND NOT (user_id % 7 = 5 AND chat_id = '48:notes')) AS messages,
  (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 7 <> 3
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderstatus = 'F')
    AND user_id NOT IN (SELECT user_id FROM ({_PENDING_SQL}) WHERE user_id % 7 = 5 AND chat_id = '48:notes')) AS finished,
  (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 7 = 3
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderstatus = 'F')) AS failed""")
def export_partial_failure(t: Tables):
    """Some requests get no response, some chats are named too long: all others are stored and done, group by group."""
    export = _export(t)
    settings = replace(export.settings, groups=3)
    user = F.substring("mailbox", 2, 20).cast("bigint")
    long = F.replace(F.col("body"), F.lit("48:notes"), F.lit("48:" + "x" * 300))
    lost = user % 7 == 3
    pages = t.spark.read.parquet(stored_pages(t)).withColumns(
        {
            "status": F.when(lost, S.STATUS_NO_RESPONSE).otherwise(F.col("status")),
            "body": F.when(lost, F.lit(None)).when(user % 7 == 5, long).otherwise(F.col("body")),
        }
    )
    export = ChatExport(t.spark, settings)
    export.store.upsert_roster(event_roster(t))
    done = export.store.read("GraphCallProcessed").agg(F.count("*")).first()[0]
    report = export.run(None, landed_pages_reader(pages))
    finished = export.store.read("GraphCallProcessed").agg(F.count("*") - F.lit(done)).scalar()
    return export.store.read("UserMessage").agg(
        F.count("*").alias("messages"),
        F.any_value(finished).alias("finished"),
        F.lit(report.failed).cast("bigint").alias("failed"),
    )


@query(f"""SELECT mailbox, CAST(1 AS BIGINT) AS finished,
  count(*) FILTER (place = 1) AS stored FROM (SELECT *, row_number() OVER (
  PARTITION BY mailbox, chat_id, id_key ORDER BY ts, event_id) AS place FROM ({MESSAGE_SQL})) GROUP BY mailbox""")
def retry_after_failure(t: Tables):
    """Every chain fails at its second page in a first attempt, and is whole in a second one: nothing is lost."""
    pages = landed_pages(t)
    failed = pages.where("page_no <= 1").withColumn(
        "status", F.when(F.col("page_no") == 1, 500).otherwise(F.col("status"))
    ).withColumn("attempt", F.lit(0))
    export = _whole_export(t)
    export.run(None, landed_pages_reader(failed))
    both = failed.unionByName(pages.withColumn("attempt", F.lit(1)))
    export.run(None, landed_pages_reader(both))
    return _stored_per_user(export)


@query(f"""SELECT mailbox, CAST(1 AS BIGINT) AS finished,
  count(*) FILTER (place = 1) AS stored FROM (SELECT *, row_number() OVER (
  PARTITION BY mailbox, chat_id, id_key ORDER BY ts, event_id) AS place FROM ({MESSAGE_SQL})) GROUP BY mailbox""")
def batch_stream_batch(t: Tables):
    """The same pages by batch, stream and batch again in one session: each key is there once."""
    export = _whole_export(t)
    landing = stored_pages(t)
    some = t.spark.read.parquet(landing).where(F.substring("mailbox", 2, 20).cast("bigint") % 3 == 0)
    export.run(None, landed_pages_reader(some))
    export.store.read("UserMessage").count()
    stream = PageStreamExport(t.spark, export.settings, scratch(t.spark, "state"))
    stream.run(page_stream(t.spark, landing, max_files=3))
    export.run(None, landed_pages_reader(t.spark.read.parquet(landing)))
    return _stored_per_user(export)


def _whole_export(t: Tables) -> ChatExport:
    """An export of everything, the users of the events as roster."""
    place = scratch(t.spark, "database")
    settings = ExportSettings(
        start="2023-01-01Z",
        end="2025-01-01Z",
        database=place.rsplit("/", 1)[1].replace("-", "_"),
        database_location=place,
    )
    export = ChatExport(t.spark, settings)
    export.store.ensure_tables()
    export.store.set_version()
    export.store.upsert_roster(event_roster(t))
    return export


def _stored_per_user(export: ChatExport) -> DataFrame:
    """Per user: rows of the progress table, and messages."""
    done = export.store.read("GraphCallProcessed").groupBy(F.col("value").alias("mailbox")).agg(F.count("*").alias("finished"))
    return export.store.read("UserMessage").groupBy("mailbox").agg(F.count("*").alias("stored")).join(done, "mailbox", "left")
