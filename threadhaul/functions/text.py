"""Functions on identifiers and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Fixed patterns: whole numbers with an optional sign and ASCII blanks around
# them; the five usual spellings of a GUID.
_WHOLE_NUMBER = r"^[\t-\r ]*[+-]?[0-9]+[\t-\r ]*$"
_GUID = (
    r"^\s*(?:"
    r"[0-9a-fA-F]{32}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}"
    r"|\([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\)"
    r"|\{\s*0x[0-9a-fA-F]{1,8}\s*(?:,\s*0x[0-9a-fA-F]{1,4}\s*){2},"
    r"\s*\{\s*0x[0-9a-fA-F]{1,2}\s*(?:,\s*0x[0-9a-fA-F]{1,2}\s*){7}\}\s*\}"
    r")\s*$"
)


def id_key(message_id: Column) -> Column:
    """The message id as a 64-bit number; 0 when it is not one."""
    number = F.when(message_id.rlike(_WHOLE_NUMBER), message_id.try_cast("bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def is_blank(value: Column) -> Column:
    """NULL or the empty string."""
    return value.isNull() | (value == "")


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def conversation_type(chat_id: Column) -> Column:
    """Kind of conversation told by the shape of its id."""
    chat = F.lower(F.regexp_replace(chat_id, r"^\s+|\s+$", ""))
    undefined, meeting, channel, group, one_on_one, notes = S.CONVERSATION_TYPES
    return (
        F.when(chat.contains(S.MEETING_MARK) & chat.endswith(S.THREAD_SUFFIX), meeting)
        .when(chat.endswith(S.CHANNEL_SUFFIX), channel)
        .when(chat.endswith(S.THREAD_SUFFIX), group)
        .when(chat.endswith(S.ONE_ON_ONE_SUFFIX), one_on_one)
        .when(chat == S.NOTES_CHAT, notes)
        .otherwise(undefined)
    )


def is_guid(value: Column) -> Column:
    return F.coalesce(value.rlike(_GUID), F.lit(False))


def wildcard_regex(pattern: str) -> str:
    """Anchored regex of a name pattern in which only `*` is special.

    `*` also crosses folder separators.
    """
    return "^" + "[^\n]*".join(re.escape(part) for part in pattern.lower().split("*")) + "$"


def wildcard_match(name: Column, pattern: str) -> Column:
    """Whether the full name matches the pattern, in any letter case."""
    if pattern == "*":
        return F.lit(True)
    if "*" not in pattern:
        return F.lower(name) == pattern.lower()
    return F.lower(name).rlike(wildcard_regex(pattern))


def rand_integer(low: int, high: int, seed: int | None = None) -> Column:
    """A random whole number in [low, high)."""
    return F.floor(F.rand(seed) * (high - low) + low)


def series_name(base: str, index: Column) -> Column:
    """`base`, then `stem_1.ext`, `stem_2.ext`, … for index 0, 1, 2, …"""
    stem, dot, extension = base.rpartition(".")
    if not dot:
        stem, extension = base, ""
    numbered = F.concat(F.lit(f"{stem}_"), index.cast("string"), F.lit(f"{dot}{extension}"))
    return F.when(index == 0, F.lit(base)).otherwise(numbered)
