"""Explicit schemas and fixed values of the export; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must match the export format and its consumers) -----------
SCHEMA_VERSION = "1.0"
ROSTER_PATTERN = "AllMailBoxes*.json"
PROGRESS_TYPE_USER = "user"
DEFAULT_PAGE_SIZE = 800
MIN_PAGE_SIZE = 10
MAX_PAGE_SIZE = 1000
MODELS = ("A", "B")
LOG_RECORDS_PER_FILE = 40000
RATE_SAMPLES = 10
STATUS_OK = 200
STATUS_SWITCH_MODEL = 402
STATUS_SKIP_USER = (401, 403, 404)
CODE_SNIPPET_TYPE = "application/vnd.microsoft.card.codesnippet"
CODE_SNIPPET_URL_FIELD = "codeSnippetUrl"
CONVERSATION_TYPES = ("Undefined", "Meeting", "Channelconversation", "Group", "OneOnOne", "Notes")
MEETING_MARK = "19:meeting"
CHANNEL_SUFFIX = "threadtac.v2"
THREAD_SUFFIX = "thread.v2"
ONE_ON_ONE_SUFFIX = "unq.gbl.spaces"
NOTES_CHAT = "48:notes"

ROSTER_TABLE = "MailBox"
PROGRESS_TABLE = "GraphCallProcessed"
MESSAGE_TABLE = "UserMessage"

ROSTER_KEY = ["ExternalDirectoryObjectId"]
PROGRESS_KEY = ["value", "type"]
MESSAGE_KEY = ["mailbox", "chatId", "idKey"]
# -----------------------------------------------------------------------------

ROSTER = T.StructType(
    [
        T.StructField("DisplayName", T.VarcharType(100)),
        T.StructField("ExternalDirectoryObjectId", T.VarcharType(50), False),
        T.StructField("PrimarySmtpAddress", T.VarcharType(100)),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("type", T.VarcharType(10), False),
        T.StructField("value", T.VarcharType(200), False),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("mailbox", T.VarcharType(50), False),
        T.StructField("chatId", T.VarcharType(200), False),
        T.StructField("idKey", T.LongType(), False),
        T.StructField("createdDateTime", T.TimestampType()),
        T.StructField("lastModifiedDateTime", T.TimestampType()),
        T.StructField("rawJson", T.StringType()),
        T.StructField("folderDate", T.TimestampType()),
        T.StructField("fromid", T.VarcharType(100)),
        T.StructField("fromdisplayname", T.VarcharType(200)),
        T.StructField("fromidentitytype", T.VarcharType(100)),
        T.StructField("fromtenantid", T.VarcharType(36)),
        T.StructField("fromtype", T.VarcharType(100)),
    ]
)

MESSAGE_COLUMNS = MESSAGE.fieldNames()

# One landed response. `model` is the licensing model the request was sent with.
LANDED_PAGE = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("next_link", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# What else a landed page may say: the slice of the window, the attempt (a run that
# walks the chain afresh has a higher number), and when the response came.
LANDED_PAGE_MORE = T.StructType(
    [
        T.StructField("slice", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

# Status of a request that got no response at all.
STATUS_NO_RESPONSE = 0

# A page chain: the requests of one mailbox for one slice of the window. Landed
# pages without a `slice` are one slice.
CHAIN_KEY = ["mailbox", "slice"]

# The people and objects inside a message. Objects that get a default when the
# key is absent are read as VARIANT first: an absent key is then NULL, an
# explicit JSON null a variant null.
USER = (
    "struct<`@odata.type` string, id string, displayName string, userIdentityType string,"
    " tenantId string, application string, device string>"
)
USER_X = f"struct<`@odata.type` string, application variant, device variant, user {USER}>"
APPLICATION = "struct<odatatype string, id string, displayName string, applicationIdentityType string>"
SENDER = f"struct<application {APPLICATION}, device string, user {USER}>"
MEMBER = "struct<id string, displayName string, userIdentityType string, tenantId string>"
EVENT_DETAIL = (
    "struct<`@odata.type` string, visibleHistoryStartDateTime timestamp,"
    " initiator variant, members variant, callParticipants variant>"
)
MEMBERS = f"array<{MEMBER}>"
PARTICIPANTS = f"array<struct<participant {USER_X}>>"
MENTIONED = "struct<user variant>"
HISTORY_REACTION = "struct<reactionType string, createdDateTime timestamp, user variant>"
ATTACHMENT = (
    "struct<id string, contentType string, contentUrl string, content string, name string,"
    " thumbnailUrl string, teamsAppId string>"
)

PAYLOAD = (
    "struct<id string, replyToId string, etag string, messageType string,"
    " createdDateTime timestamp, lastModifiedDateTime timestamp,"
    " lastEditedDateTime timestamp, deletedDateTime timestamp,"
    " subject string, summary string, chatId string, importance string, locale string, webUrl string,"
    " eventDetail variant, `from` variant,"
    " body struct<contentType string, content string>,"
    f" attachments array<{ATTACHMENT}>,"
    " reactions array<struct<reactionType string, createdDateTime timestamp, user variant>>,"
    " mentions array<struct<id int, mentionText string, mentioned variant>>,"
    " messageHistory array<struct<modifiedDateTime timestamp, actions string, reaction variant>>>"
)

CORRUPT = "_corrupt_record"

PAGE = (
    "`@odata.context` string, `@odata.count` int, `@odata.nextLink` string,"
    f" value array<{PAYLOAD}>, {CORRUPT} string"
)
