"""Landed pages: one row per response, the body holding a list of messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def parse_pages(pages: DataFrame) -> DataFrame:
    """Parse each body once and add `items` and `malformed`.

    A consumed page (status 200) is malformed when it has no body, when the
    body does not fit the schema, or when the message list is missing or holds
    a null. Bodies of other statuses are not parsed.
    """
    ok = F.col("status") == S.STATUS_OK
    parsed = F.from_json(
        F.when(ok, F.col("body")), S.PAGE, {"columnNameOfCorruptRecord": S.CORRUPT}
    )
    items = F.col("page.value")
    malformed = ok & (
        items.isNull()
        | F.col(f"page.{S.CORRUPT}").isNotNull()
        | F.exists(items, lambda item: item.isNull())
    )
    return (
        pages.withColumn("page", parsed)
        .withColumn("malformed", F.coalesce(malformed, F.lit(False)))
        .withColumn("items", F.when(~F.col("malformed"), items))
        .withColumn("held", F.coalesce(F.size("items"), F.lit(0)))
        .drop("page", "body")
    )


def explode_pages(
    pages: DataFrame, keep_empty: bool = False, window: tuple[datetime, datetime] | None = None
) -> DataFrame:
    """One row per message: the page columns, `held` (messages of the page), `position` and `message`.

    The mailbox of the page goes with every message. With `keep_empty`, a page
    without messages gives one row with a NULL position, so that its status is
    not lost. With a `window`, messages modified outside it (bounds excluded) are left
    out before they become rows.
    """
    parsed = parse_pages(pages)
    kept = [name for name in parsed.columns if name != "items"]
    items = F.transform("items", lambda message, at: F.struct(at.alias("position"), message.alias("message")))
    if window is not None:
        start, end = (F.lit(bound) for bound in window)

        def inside(item: Column) -> Column:
            time = item["message"]["lastModifiedDateTime"]
            return (time > start) & (time < end)

        items = F.filter(items, inside)
    explode = F.explode_outer if keep_empty else F.explode
    return parsed.select(*kept, explode(items).alias("item")).select(
        *kept, F.col("item.position").alias("position"), F.col("item.message").alias("message")
    )


def parse_single_doc(pages: DataFrame, schema: str) -> DataFrame:
    """Documents fetched without paging: `document` holds the parsed body whole.

    Users to skip give no row; any other status, or a body that does not fit,
    is an error.
    """
    document = F.from_json("body", schema, {"mode": "FAILFAST"})
    return pages.where(~F.col("status").isin(*S.STATUS_SKIP_USER)).select(
        "mailbox",
        F.when(F.col("status") == S.STATUS_OK, document)
        .otherwise(_fail("failed to get data for ", F.col("mailbox")))
        .alias("document"),
    )


def _fail(text: str, what: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), what))
