"""Functions on attachments and reactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _is_snippet(attachment: Column) -> Column:
    content = attachment["content"]
    return (
        (attachment["contentType"] == S.CODE_SNIPPET_TYPE) & content.isNotNull() & (content != "")
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value being computed once, also inside of other lambdas."""
    return F.transform(F.array(value), use)[0]


def attachment_link(attachment: Column) -> Column:
    """(`url`, `bad`): what `attachment_url` and `attachment_url_problem` say, the content being parsed once."""
    snippet = F.coalesce(_is_snippet(attachment), F.lit(False))

    def judged(parsed: Column, url: Column) -> Column:
        is_object, kind = F.schema_of_variant(parsed).startswith("OBJECT"), F.schema_of_variant(url)
        text = F.when(kind == "STRING", F.try_variant_get(url, "$", "string"))
        link = (
            F.when(~snippet, attachment["contentUrl"])
            .when(parsed.isNull(), F.lit(None).cast("string"))
            .when(is_object, text)
            .otherwise(attachment["contentUrl"])
        )
        usable = F.coalesce(kind.isin("STRING", "VOID"), F.lit(False))
        return F.struct(link.alias("url"), (snippet & (parsed.isNull() | (is_object & ~usable))).alias("bad"))

    def found(parsed: Column) -> Column:
        url = F.try_variant_get(parsed, f"$.{S.CODE_SNIPPET_URL_FIELD}", "variant")
        return _once(url, lambda url: judged(parsed, url))

    return _once(F.when(snippet, F.try_parse_json(attachment["content"])), found)


def attachment_links(attachments: Column) -> Column:
    """The link of each attachment of a message."""
    return F.transform(attachments, attachment_link)


def attachment_url(attachment: Column) -> Column:
    """URL of an attachment.

    Code snippets carry it inside their JSON content. Content that is JSON but
    not an object leaves the stored URL; content that is no JSON, or an object
    without a text URL, gives NULL (see `attachment_url_problem`).
    """
    return attachment_link(attachment)["url"]


def attachment_url_problem(attachment: Column) -> Column:
    """Whether a code snippet's content gives no usable URL (counted as a quality issue)."""
    return attachment_link(attachment)["bad"]


def attachment_key(attachment: Column) -> Column:
    """`id_contentType`, a missing part being empty."""
    return F.concat(
        F.coalesce(attachment["id"], F.lit("")),
        F.lit("_"),
        F.coalesce(attachment["contentType"], F.lit("")),
    )


def reaction_key(created: Column, user_id: Column, reaction_type: Column) -> Column:
    """`created_user_reaction`, with an ISO timestamp, a missing part being empty."""
    stamp = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    parts = [F.coalesce(part, F.lit("")) for part in (stamp, user_id, reaction_type)]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2])
