"""Column functions of the export; all are built from JVM-side expressions."""

from .attachments import attachment_key, attachment_links, attachment_url, attachment_url_problem, reaction_key
from .clock import folder_date, parse_bound, specify_utc, ts_to_unix_ms, unix_ms_to_ts
from .payload import raw_json, sender
from .senders import sender_columns
from .text import (
    conversation_type,
    id_key,
    is_blank,
    is_guid,
    null_if_empty,
    rand_integer,
    series_name,
    wildcard_match,
    wildcard_regex,
)

__all__ = [
    "attachment_key",
    "attachment_links",
    "attachment_url",
    "attachment_url_problem",
    "conversation_type",
    "folder_date",
    "id_key",
    "is_blank",
    "is_guid",
    "null_if_empty",
    "parse_bound",
    "rand_integer",
    "raw_json",
    "reaction_key",
    "sender",
    "sender_columns",
    "series_name",
    "specify_utc",
    "ts_to_unix_ms",
    "unix_ms_to_ts",
    "wildcard_match",
    "wildcard_regex",
]
