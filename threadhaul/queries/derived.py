"""Export inputs derived from the given tables.

Customers are the roster and orders the progress. Every event is a message: its
user is the mailbox, its type tells the chat, its id the sender's shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.ordinal import paginate
from ..runtime import scratch
from .registry import Tables, plain, text

PAGE_ROWS = 10

# What the messages below must come out as.
MESSAGE_SQL = """
SELECT
  'u' || user_id AS mailbox,
  CASE event_type
    WHEN 'signup' THEN '19:meeting_' || user_id || '@thread.v2'
    WHEN 'view' THEN '19:' || user_id || '@threadtac.v2'
    WHEN 'click' THEN '19:' || user_id || '@thread.v2'
    WHEN 'error' THEN '19:' || user_id || '@unq.gbl.spaces'
    ELSE '48:notes' END AS chat_id,
  CASE WHEN event_id % 11 = 0 THEN 'm' || event_id ELSE CAST(event_id AS VARCHAR) END AS message_id,
  CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END AS id_key,
  event_id, user_id, event_type, ts, props,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS folder_date,
  CASE event_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'a' || event_type END AS from_id,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'bot' END AS from_name,
  CASE event_id % 4 WHEN 0 THEN 'aadUser' WHEN 1 THEN 'bot' END AS from_identity,
  CASE event_id % 4 WHEN 0 THEN 't' || user_id END AS from_tenant,
  CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'application' WHEN 2 THEN 'device' END AS from_type
FROM events"""

PAGED_SQL = f"""
SELECT *, (ordinal - 1) // {PAGE_ROWS} AS page_no, (ordinal - 1) % {PAGE_ROWS} AS position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal
      FROM ({MESSAGE_SQL}))"""


def roster(tables: Tables) -> DataFrame:
    return tables.customer.select(
        F.col("c_name").alias("DisplayName"),
        F.concat(F.lit("u"), "c_custkey").alias("ExternalDirectoryObjectId"),
        F.concat("c_mktsegment", F.lit("@sample.com")).alias("PrimarySmtpAddress"),
    )


def event_roster(tables: Tables) -> DataFrame:
    """The users of the events as roster rows."""
    users = tables.events.select(F.concat(F.lit("u"), "user_id").alias("ExternalDirectoryObjectId")).distinct()
    return users.select(
        F.lit(None).cast("string").alias("DisplayName"),
        "ExternalDirectoryObjectId",
        F.lit(None).cast("string").alias("PrimarySmtpAddress"),
        F.lit("").alias("file_path"),
        F.lit(0).alias("block_start"),
        F.lit(0).alias("position"),
    )


def progress(tables: Tables) -> DataFrame:
    """Users with a finished order are done; other orders are progress of another type."""
    return tables.orders.select(
        F.when(F.col("o_orderstatus") == "F", S.PROGRESS_TYPE_USER)
        .otherwise("other")
        .alias("type"),
        F.concat(F.lit("u"), "o_custkey").alias("value"),
    )


def messages(events: DataFrame, *keep: str) -> DataFrame:
    """`mailbox`, `event_id`, and `json`: the message of each event."""
    user, kind, number = F.col("user_id"), F.col("event_type"), F.col("event_id")
    chat = (
        F.when(kind == "signup", F.concat(F.lit("19:meeting_"), user, F.lit("@thread.v2")))
        .when(kind == "view", F.concat(F.lit("19:"), user, F.lit("@threadtac.v2")))
        .when(kind == "click", F.concat(F.lit("19:"), user, F.lit("@thread.v2")))
        .when(kind == "error", F.concat(F.lit("19:"), user, F.lit("@unq.gbl.spaces")))
        .otherwise("48:notes")
    )
    person = F.struct(
        F.concat(F.lit("u"), user).alias("id"),
        kind.alias("displayName"),
        F.lit("aadUser").alias("userIdentityType"),
        F.concat(F.lit("t"), user).alias("tenantId"),
    )
    program = F.struct(
        F.concat(F.lit("a"), kind).alias("id"),
        F.lit("bot").alias("displayName"),
        F.lit("bot").alias("applicationIdentityType"),
    )
    shape = number % 4
    sender = F.struct(
        F.when(shape == 0, person).alias("user"),
        F.when(shape == 1, program).alias("application"),
        F.when(shape == 2, "phone").alias("device"),
    )
    snippet = F.struct(
        F.concat(F.lit("s"), number).alias("id"),
        F.lit(S.CODE_SNIPPET_TYPE).alias("contentType"),
        F.lit("stored").alias("contentUrl"),
        F.to_json(F.struct(F.concat(F.lit("http://s/"), number).alias(S.CODE_SNIPPET_URL_FIELD))).alias(
            "content"
        ),
    )
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    message = F.struct(
        F.when(number % 11 == 0, F.concat(F.lit("m"), number)).otherwise(text("event_id")).alias("id"),
        chat.alias("chatId"),
        stamp.alias("createdDateTime"),
        stamp.alias("lastModifiedDateTime"),
        F.when(shape < 3, sender).alias("from"),
        F.struct(F.lit("text").alias("contentType"), F.col("props").alias("content")).alias("body"),
        F.when(kind == "click", F.array(snippet)).alias("attachments"),
    )
    return events.select(
        F.concat(F.lit("u"), user).alias("mailbox"),
        "event_id",
        F.to_json(message).alias("json"),
        *keep,
    )


def payloads(tables: Tables) -> DataFrame:
    """`mailbox`, `event_id` and `message`: the parsed message of each event."""
    return messages(tables.events).select(
        "mailbox", "event_id", F.from_json("json", S.PAYLOAD).alias("message")
    )


def paged_events(tables: Tables, *columns: str) -> DataFrame:
    """Events with the page and the position they have in the chain of their mailbox."""
    events = tables.events.select("user_id", "ts", "event_id", *columns)
    return paginate(events, "user_id", ["ts", "event_id"], PAGE_ROWS)


def landed_pages(tables: Tables) -> DataFrame:
    """One page of up to `PAGE_ROWS` messages per row, as the service would send it."""
    paged = messages(paged_events(tables, "event_type", "props"), "page_no", "position")
    grouped = paged.groupBy("mailbox", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("position", "json"))).alias("items")
    )
    # The last page follows from the number of messages; pages need not be numbered a second time for it.
    held = tables.events.groupBy(F.concat(F.lit("u"), "user_id").alias("mailbox")).agg(F.count("*").alias("held"))
    last = held.select("mailbox", F.call_function("div", F.col("held") - 1, F.lit(PAGE_ROWS)).alias("last_page"))
    link = F.when(
        F.col("page_no") < F.col("last_page"),
        F.concat("mailbox", F.lit("#"), F.col("page_no") + 1),
    )
    # The messages are JSON already, so the page is put together as text.
    body = F.concat(
        F.lit('{"@odata.count":'),
        F.size("items"),
        F.when(link.isNotNull(), F.concat(F.lit(',"@odata.nextLink":"'), link, F.lit('"'))).otherwise(""),
        F.lit(',"value":['),
        F.array_join(F.transform("items", lambda item: item["json"]), ","),
        F.lit("]}"),
    )
    return grouped.join(last, "mailbox").select(
        "mailbox",
        "page_no",
        F.lit(S.STATUS_OK).alias("status"),
        F.lit(S.MODELS[0]).alias("model"),
        link.alias("next_link"),
        body.alias("body"),
    )


def stored_pages(tables: Tables) -> str:
    """Landed pages in Parquet files; the folder they lie in."""
    path = scratch(tables.spark, "landing")
    landed_pages(tables).write.parquet(path)
    return path


def judged_page_sql() -> str:
    """Pages with responses of all kinds, as `responses` makes them."""
    return f"""
SELECT mailbox, page_no, status, model, next_link,
  CASE WHEN status = 200 THEN 'consume' WHEN status IN (401, 403, 404) THEN 'skip'
       WHEN status = 402 AND model = 'A' THEN 'switch' ELSE 'fail' END AS disposition,
  page_no * 2 + CASE WHEN model = 'B' THEN 1 ELSE 0 END AS chain_pos,
  status IN (401, 403, 404) OR (status = 402 AND model = 'B')
    OR status NOT IN (200, 401, 402, 403, 404)
    OR (status = 200 AND next_link IS NULL) AS terminal
FROM (
  SELECT mailbox, page_no,
    CASE (user_id + page_no * 3) % 17 WHEN 0 THEN 403 WHEN 1 THEN 402 WHEN 2 THEN 500
         WHEN 3 THEN 404 WHEN 4 THEN 204 ELSE 200 END AS status,
    CASE WHEN (user_id + page_no) % 5 = 0 THEN 'B' ELSE 'A' END AS model,
    CASE WHEN page_no < max(page_no) OVER (PARTITION BY mailbox)
         THEN mailbox || '#' || (page_no + 1) END AS next_link
  FROM (SELECT DISTINCT mailbox, user_id, page_no FROM ({PAGED_SQL})))"""


def responses(tables: Tables) -> DataFrame:
    """The pages of each mailbox with statuses of every kind, without bodies."""
    pages = paged_events(tables).select(
        F.concat(F.lit("u"), "user_id").alias("mailbox"), "user_id", "page_no"
    ).distinct()
    last = pages.groupBy("mailbox").agg(F.max("page_no").alias("last_page"))
    mark = (F.col("user_id") + F.col("page_no") * 3) % 17
    status = F.lit(S.STATUS_OK)
    for value, kind in ((0, 403), (1, 402), (2, 500), (3, 404), (4, 204)):
        status = F.when(mark == value, kind).otherwise(status)
    return pages.join(last, "mailbox").select(
        "mailbox",
        "page_no",
        status.alias("status"),
        F.when((F.col("user_id") + F.col("page_no")) % 5 == 0, "B").otherwise("A").alias("model"),
        F.when(
            F.col("page_no") < F.col("last_page"),
            F.concat("mailbox", F.lit("#"), F.col("page_no") + 1),
        ).alias("next_link"),
    )


def shown(messages: DataFrame) -> DataFrame:
    """Message rows without the JSON, timestamps without their zone."""
    return messages.select(
        *[
            plain(F.col(name)).alias(name) if kind == "timestamp" else name
            for name, kind in messages.dtypes
            if name != "rawJson"
        ]
    )


SHOWN_SQL = """mailbox, chat_id AS "chatId", id_key AS "idKey", ts AS "createdDateTime",
  ts AS "lastModifiedDateTime", folder_date AS "folderDate", from_id AS fromid,
  from_name AS fromdisplayname, from_identity AS fromidentitytype,
  from_tenant AS fromtenantid, from_type AS fromtype"""
