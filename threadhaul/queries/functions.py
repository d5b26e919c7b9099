"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from .. import schemas as S
from ..plans.messages import normalize_messages as normalize
from .derived import MESSAGE_SQL, SHOWN_SQL, payloads, shown
from .registry import Tables, plain, query, text


@query("""SELECT event_id, CASE event_id % 6
  WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN event_id ELSE 0 END AS id_key FROM events""")
def id_key(t: Tables):
    """Plain, negative and padded numbers; fractions, words and numbers out of range."""
    number = text("event_id")
    shape = F.col("event_id") % 6
    given = (
        F.when(shape == 0, number)
        .when(shape == 1, F.concat(F.lit("-"), number))
        .when(shape == 2, F.concat(F.lit(" +"), number, F.lit("\t")))
        .when(shape == 3, F.concat(number, F.lit(".5")))
        .when(shape == 4, F.concat(F.lit("x"), number))
        .otherwise(F.concat(F.lit("9223372036854775808"), number))
    )
    return t.events.select("event_id", X.id_key(given).alias("id_key"))


@query("SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS folder_date FROM events")
def folder_date(t: Tables):
    return t.events.select(
        "event_id", plain(X.folder_date(F.col("ts").cast("timestamp"))).alias("folder_date")
    )


@query(f"""SELECT mailbox, event_id, from_id AS fromid, from_name AS fromdisplayname,
  from_identity AS fromidentitytype, from_tenant AS fromtenantid, from_type AS fromtype
FROM ({MESSAGE_SQL})""")
def sender_columns(t: Tables):
    columns = X.sender_columns(X.sender(F.col("message")))
    return payloads(t).select(
        "mailbox", "event_id", *[column.alias(name) for name, column in columns.items()]
    )


@query(f"SELECT {SHOWN_SQL}, event_id FROM ({MESSAGE_SQL})")
def normalize_messages(t: Tables):
    return shown(normalize(payloads(t), "event_id"))


@query(f"""SELECT message_id AS id, chat_id AS chat, from_id AS sender, from_type = 'device' AS phone,
  '[]' AS members, props AS content, epoch_us(ts) AS modified,
  CASE WHEN event_type = 'click' THEN 'http://s/' || event_id END AS url,
  from_type IS NULL AS empty_sender
FROM (SELECT * REPLACE (coalesce(from_type, 'none') AS from_type) FROM ({MESSAGE_SQL}))""".replace(
    "from_type IS NULL AS", "from_type = 'none' AS"))
def raw_json(t: Tables):
    """The JSON written for each message, read back field by field."""
    written = payloads(t).select(F.parse_json(X.raw_json(F.col("message"))).alias("j"))

    def field(path: str, kind: str = "string"):
        return F.variant_get("j", path, kind)

    return written.select(
        field("$.id").alias("id"),
        field("$.chatId").alias("chat"),
        F.coalesce(field("$.from.user.id"), field("$.from.application.id")).alias("sender"),
        field("$.from.device").isNotNull().alias("phone"),
        F.to_json(field("$.eventDetail.members", "variant")).alias("members"),
        field("$.body.content").alias("content"),
        F.unix_micros(field("$.lastModifiedDateTime", "timestamp")).alias("modified"),
        field("$.attachments[0].contentUrl").alias("url"),
        F.coalesce(
            field("$.from.user.id"), field("$.from.application.id"), field("$.from.device")
        ).isNull().alias("empty_sender"),
    )


def _attachments(t: Tables):
    """An attachment per page: snippets with good, empty, non-object and bad content, and others."""
    shape = F.col("page_id") % 6
    content = (
        F.when(shape == 0, F.to_json(F.struct(F.col("url").alias(S.CODE_SNIPPET_URL_FIELD))))
        .when(shape == 1, "")
        .when(shape == 2, "[1]")
        .when(shape == 3, F.col("html"))
        .when(shape == 4, "{}")
        .otherwise(F.to_json(F.struct(F.col("url").alias(S.CODE_SNIPPET_URL_FIELD))))
    )
    return t.pages.select(
        "page_id",
        F.struct(
            F.when(shape != 1, text("page_id")).alias("id"),
            F.when(shape < 5, S.CODE_SNIPPET_TYPE).otherwise("reference").alias("contentType"),
            F.concat(F.lit("stored:"), "url").alias("contentUrl"),
            content.alias("content"),
        ).alias("a"),
    )


@query("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN url
  WHEN page_id % 6 IN (3, 4) THEN NULL ELSE 'stored:' || url END AS url,
  page_id % 6 IN (3, 4) AS problem FROM pages""")
def attachment_url(t: Tables):
    a = F.col("a")
    return _attachments(t).select(
        "page_id", X.attachment_url(a).alias("url"), X.attachment_url_problem(a).alias("problem")
    )


@query(f"""SELECT page_id, CASE WHEN page_id % 6 <> 1 THEN CAST(page_id AS VARCHAR) ELSE '' END || '_' ||
  CASE WHEN page_id % 6 < 5 THEN '{S.CODE_SNIPPET_TYPE}' ELSE 'reference' END AS "key" FROM pages""")
def attachment_key(t: Tables):
    return _attachments(t).select("page_id", X.attachment_key(F.col("a")).alias("key"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z_' ||
  CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END || '_' || event_type AS "key"
FROM events""")
def reaction_key(t: Tables):
    user = F.when(F.col("event_type") != "error", text("user_id"))
    key = X.reaction_key(F.col("ts").cast("timestamp"), user, F.col("event_type"))
    return t.events.select("event_id", key.alias("key"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Meeting'
  WHEN 1 THEN 'Channelconversation' WHEN 2 THEN 'Group' WHEN 3 THEN 'OneOnOne'
  WHEN 4 THEN 'Notes' ELSE 'Undefined' END AS kind FROM conversations""")
def conversation_type(t: Tables):
    number, shape = text("conv_id"), (F.col("conv_id") + F.col("turn")) % 6
    chat = (
        F.when(shape == 0, F.concat(F.lit("19:Meeting_"), number, F.lit("@thread.v2")))
        .when(shape == 1, F.concat(F.lit("19:"), number, F.lit("@threadTac.v2")))
        .when(shape == 2, F.concat(F.lit("\t19:"), number, F.lit("@thread.v2 ")))
        .when(shape == 3, F.concat(F.lit("19:"), number, F.lit("@unq.gbl.spaces")))
        .when(shape == 4, " 48:NOTES\n")
        .otherwise(F.concat(F.lit("19:"), number))
    )
    return t.conversations.select("conv_id", "turn", X.conversation_type(chat).alias("kind"))


@query("""SELECT conv_id, turn, (conv_id + turn) % 6 < 4 AS guid FROM conversations""")
def is_guid(t: Tables):
    """Digests written as GUIDs in four spellings, mismatched brackets, and the plain text."""
    digest, shape = F.md5("text"), (F.col("conv_id") + F.col("turn")) % 6
    dashed = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    given = (
        F.when(shape == 0, digest)
        .when(shape == 1, F.upper(dashed))
        .when(shape == 2, F.concat(F.lit("{"), dashed, F.lit("}")))
        .when(shape == 3, F.concat(F.lit(" ("), dashed, F.lit(") ")))
        .when(shape == 4, F.concat(F.lit("{"), dashed, F.lit(")")))
        .otherwise(F.col("text"))
    )
    return t.conversations.select("conv_id", "turn", X.is_guid(given).alias("guid"))


@query("""SELECT page_id, lower(url) LIKE '%.example.com/%?page=%' AS paged,
  lower(url) LIKE 'http://%' AS http, lower(url) = 'http://example.com' AS home, true AS anything
FROM pages""")
def wildcard_match(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        X.wildcard_match(url, "*.EXAMPLE.com/*?page=*").alias("paged"),
        X.wildcard_match(url, "http://*").alias("http"),
        X.wildcard_match(url, "http://example.com").alias("home"),
        X.wildcard_match(url, "*").alias("anything"),
    )


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts FROM events")
def unix_ms_to_ts(t: Tables):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", plain(X.unix_ms_to_ts(millis)).alias("ts"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE
    (CASE WHEN us < 0 THEN -1 ELSE 1 END) * (abs(us) // 1000) END AS ms
FROM (SELECT event_id, event_type, epoch_us(
    CASE WHEN event_type = 'view' THEN ts - INTERVAL 60 YEAR ELSE ts END) AS us FROM events)""")
def ts_to_unix_ms(t: Tables):
    """Times now and before the epoch, and missing ones."""
    kind, ts = F.col("event_type"), F.col("ts")
    given = F.when(kind == "view", ts - F.make_ym_interval(F.lit(60))).when(kind != "error", ts)
    return t.events.select("event_id", X.ts_to_unix_ms(given).alias("ms"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def specify_utc(t: Tables):
    return t.events.select("event_id", F.unix_micros(X.specify_utc(F.col("ts"))).alias("us"))


@query("SELECT count(*) AS n, true AS inside FROM events")
def rand_integer(t: Tables):
    """Random numbers differ from engine to engine; their range does not."""
    drawn = t.events.select(X.rand_integer(-3, 9, seed=7).alias("r"))
    return drawn.agg(
        F.count("*").alias("n"), F.bool_and((F.col("r") >= -3) & (F.col("r") < 9)).alias("inside")
    )
