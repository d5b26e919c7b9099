"""From exploded pages to rows of the message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VarcharType

from .. import schemas as S
from ..functions import (
    attachment_links,
    folder_date,
    id_key,
    raw_json,
    sender,
    sender_columns,
)
from ..operators.filters import length_problem, message_problem

# Order of messages within a mailbox: the first one wins.
MESSAGE_ORDER = ["slice", "chain_pos", "position"]


def message_columns(links: Column | None = None) -> dict:
    """The twelve stored columns, from `mailbox` and the parsed `message` (`links` as in `raw_json`)."""
    message = F.col("message")
    modified = message["lastModifiedDateTime"]
    return {
        "mailbox": F.col("mailbox"),
        "chatId": message["chatId"],
        "idKey": id_key(message["id"]),
        "createdDateTime": message["createdDateTime"],
        "lastModifiedDateTime": modified,
        "rawJson": raw_json(message, links),
        "folderDate": folder_date(modified),
        **sender_columns(sender(message)),
    }


def normalize_messages(exploded: DataFrame, *keep: str, links: Column | None = None) -> DataFrame:
    """The stored columns of each message, and the columns to keep beside them."""
    columns = {name: column.alias(name) for name, column in message_columns(links).items()}
    return exploded.select(*[columns[name] for name in S.MESSAGE_COLUMNS], *keep)


def checked_messages(exploded: DataFrame, *keep: str) -> DataFrame:
    """Like `normalize_messages`, with `message_id`, `problem` and `bad_urls` for the report."""
    message = F.col("message")
    lengths = {f.name: f.dataType.length for f in S.MESSAGE.fields if isinstance(f.dataType, VarcharType)}
    missing = message_problem(F.col("mailbox"), message["chatId"], message["id"])
    # A column of its own, as it is used twice: each content is parsed once.
    exploded = exploded.withColumn("links", attachment_links(message["attachments"]))
    bad_urls = F.size(F.filter("links", lambda link: link["bad"]))
    return normalize_messages(
        exploded.withColumns(
            {
                "message_id": message["id"],
                "problem": F.coalesce(missing, length_problem(message_columns(), lengths)),
                "bad_urls": F.coalesce(F.greatest(bad_urls, F.lit(0)), F.lit(0)),
            }
        ),
        "message_id",
        "problem",
        "bad_urls",
        *keep,
        links=F.col("links"),
    )
