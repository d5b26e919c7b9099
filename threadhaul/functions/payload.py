"""Typed view of a message payload and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .attachments import attachment_links

_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _typed(value: Column, ddl: str, default: Column | None = None) -> Column:
    """A variant as a typed value; `default` stands in only where the key was absent."""
    typed = F.try_variant_get(value, "$", ddl)
    if default is None:
        return typed
    return (
        F.when(value.isNull(), default)
        .when(F.is_variant_null(value), F.lit(None))
        .otherwise(typed)
    )


def _empty(ddl: str) -> Column:
    """An object of the given type in which every field is null."""
    return F.from_json(F.lit("{}"), ddl)


def _no_items(ddl: str) -> Column:
    return F.from_json(F.lit("[]"), ddl)


def _each(items: Column, build) -> Column:
    """Rebuild every item of a list, leaving null items null."""
    return F.transform(items, lambda item: F.when(item.isNotNull(), build(item)))


def _reaction(value: Column) -> Column:
    return F.struct(
        value["reactionType"].alias("reactionType"),
        value["createdDateTime"].alias("createdDateTime"),
        _typed(value["user"], S.USER_X, _empty(S.USER_X)).alias("user"),
    )


def _event_detail(value: Column) -> Column:
    present = F.coalesce(_typed(value, S.EVENT_DETAIL), _empty(S.EVENT_DETAIL))
    built = F.struct(
        present["@odata.type"].alias("@odata.type"),
        present["visibleHistoryStartDateTime"].alias("visibleHistoryStartDateTime"),
        _typed(present["initiator"], S.USER_X, _empty(S.USER_X)).alias("initiator"),
        _typed(present["members"], S.MEMBERS, _no_items(S.MEMBERS)).alias("members"),
        _typed(present["callParticipants"], S.PARTICIPANTS, _no_items(S.PARTICIPANTS)).alias(
            "callParticipants"
        ),
    )
    return F.when(value.isNull() | ~F.is_variant_null(value), built)


def _mentioned(value: Column) -> Column:
    present = F.coalesce(_typed(value, S.MENTIONED), _empty(S.MENTIONED))
    built = F.struct(_typed(present["user"], S.USER, _empty(S.USER)).alias("user"))
    return F.when(value.isNull() | ~F.is_variant_null(value), built)


def _history_reaction(value: Column) -> Column:
    present = F.coalesce(_typed(value, S.HISTORY_REACTION), _empty(S.HISTORY_REACTION))
    return F.when(value.isNull() | ~F.is_variant_null(value), _reaction(present))


def sender(payload: Column) -> Column:
    """The typed sender; an absent sender and a null one both have no parts."""
    return _typed(payload["from"], S.SENDER)


def raw_json(payload: Column, links: Column | None = None) -> Column:
    """The message written back as JSON: the known fields only, nulls included.

    Objects the format always carries are filled in when the source left the
    key out, and stay null when the source said null. `links` are the `attachment_links`, where they are known already.
    """
    links = attachment_links(payload["attachments"]) if links is None else links
    plain = [
        "id",
        "replyToId",
        "etag",
        "messageType",
        "createdDateTime",
        "lastModifiedDateTime",
        "lastEditedDateTime",
        "deletedDateTime",
        "subject",
        "summary",
        "chatId",
        "importance",
        "locale",
        "webUrl",
    ]
    full = F.struct(
        *[payload[name].alias(name) for name in plain],
        _event_detail(payload["eventDetail"]).alias("eventDetail"),
        _typed(payload["from"], S.SENDER, _empty(S.SENDER)).alias("from"),
        payload["body"].alias("body"),
        F.zip_with(
            payload["attachments"],
            links,
            lambda a, link: F.when(a.isNotNull(), a.withField("contentUrl", link["url"])),
        ).alias("attachments"),
        _each(payload["reactions"], _reaction).alias("reactions"),
        _each(
            payload["mentions"],
            lambda m: F.struct(
                F.coalesce(m["id"], F.lit(0)).alias("id"),
                m["mentionText"].alias("mentionText"),
                _mentioned(m["mentioned"]).alias("mentioned"),
            ),
        ).alias("mentions"),
        _each(
            payload["messageHistory"],
            lambda h: F.struct(
                h["modifiedDateTime"].alias("modifiedDateTime"),
                h["actions"].alias("actions"),
                _history_reaction(h["reaction"]).alias("reaction"),
            ),
        ).alias("messageHistory"),
    )
    return F.to_json(full, {"ignoreNullFields": "false", "timestampFormat": _TIMESTAMP_FORMAT})
