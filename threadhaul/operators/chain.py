"""Judging the page chains of the mailboxes.

A mailbox has one chain, or one for each slice its window was cut into.

Pages count in order up to and including the first one that ends the chain.
That page is found by one minimum per chain, which is combined before the
shuffle, so no mailbox is ever sorted or collected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

CONSUME, SKIP, SWITCH, FAIL = "consume", "skip", "switch", "fail"
COMPLETE, SKIPPED, FAILED, OPEN = "complete", "skipped", "failed", "open"


def classify_status(status: Column, model: Column, first_model: str = S.MODELS[0]) -> Column:
    """What a response means: consume it, skip the user, switch the model, or fail.

    Payment is asked for at most once per chain: a request that already used
    the other model has failed.
    """
    may_switch = ~_is_retry(model, first_model)
    return (
        F.when(status == S.STATUS_OK, CONSUME)
        .when(status.isin(*S.STATUS_SKIP_USER), SKIP)
        .when((status == S.STATUS_SWITCH_MODEL) & may_switch, SWITCH)
        .otherwise(FAIL)
    )


def _is_retry(model: Column, first_model: str) -> Column:
    """Whether a request was sent after the model had been switched."""
    return F.coalesce(model != first_model, F.lit(False))


def chain_position(page_no: Column, model: Column, first_model: str = S.MODELS[0]) -> Column:
    """Order of the responses of a mailbox: a page asked for again comes after the refusal."""
    return page_no.cast("bigint") * 2 + _is_retry(model, first_model).cast("bigint")


def with_disposition(pages: DataFrame, first_model: str = S.MODELS[0]) -> DataFrame:
    """Add `disposition`, `terminal`, `chain_pos`, and a missing `slice` or `attempt` (0) to landed pages.

    A page marked `malformed` fails. It is optional: without the column bodies
    are not looked at.
    """
    disposition = classify_status(F.col("status"), F.col("model"), first_model)
    if "malformed" in pages.columns:
        disposition = F.when(F.col("malformed"), FAIL).otherwise(disposition)
    for name in ("slice", "attempt"):
        known = F.col(name) if name in pages.columns else F.lit(None)
        pages = pages.withColumn(name, F.coalesce(known.cast("int"), F.lit(0)))
    last = (F.col("disposition") == CONSUME) & F.col("next_link").isNull()
    return (
        pages.withColumn("disposition", disposition)
        .withColumn("terminal", F.col("disposition").isin(SKIP, FAIL) | last)
        .withColumn("chain_pos", chain_position(F.col("page_no"), F.col("model"), first_model))
    )


ATTEMPT_KEY = [*S.CHAIN_KEY, "attempt"]


def chain_outcomes(judged: DataFrame) -> DataFrame:
    """Per attempt at a chain: `cutoff`, the last position seen, and the outcome.

    A chain has ended only when every page before its end was consumed; one with a
    gap is still open. Pages are reduced to one row each first, as a page may have
    been landed several times.
    """
    at_end = F.when(F.col("terminal"), F.col("chain_pos"))
    # Small numbers instead of names keep the aggregation in fixed-width buffers.
    code = (
        F.when(F.col("disposition") == CONSUME, 0).when(F.col("disposition") == SKIP, 1).otherwise(2)
    )
    pages = judged.groupBy(*ATTEMPT_KEY, "page_no").agg(
        F.min(at_end).alias("__end"),
        F.min_by(code, at_end).alias("__code"),
        F.max("chain_pos").alias("__pos"),
        F.bool_or(F.col("disposition") == CONSUME).alias("__consumed"),
    )
    ends = pages.groupBy(*ATTEMPT_KEY).agg(
        F.min("__end").alias("cutoff"),
        F.min_by("__code", "__end").alias("__code"),
        F.max("__pos").alias("last_pos"),
    )
    before = (
        pages.where("__consumed")
        .select(*ATTEMPT_KEY, "page_no")
        .join(ends.select(*ATTEMPT_KEY, "cutoff"), ATTEMPT_KEY)
        .where(F.col("page_no") < F.floor(F.col("cutoff") / 2))
        .groupBy(*ATTEMPT_KEY)
        .agg(F.count("*").alias("__before"))
    )
    whole = F.coalesce("__before", F.lit(0)) == F.floor(F.col("cutoff") / 2)
    outcome = (
        F.when(F.col("cutoff").isNull(), OPEN)
        .when(F.col("__code") == 2, FAILED)
        .when(~whole, OPEN)
        .when(F.col("__code") == 0, COMPLETE)
        .otherwise(SKIPPED)
    )
    return ends.join(before, ATTEMPT_KEY, "left").withColumn("outcome", outcome).drop("__code", "__before")


def beyond_end(outcomes: DataFrame) -> DataFrame:
    """The chains with rows beyond their end: none unless pages were landed after it."""
    return outcomes.where(F.col("last_pos") > F.col("cutoff")).select(*ATTEMPT_KEY, "cutoff")


def within_chain(judged: DataFrame, overlong: DataFrame) -> DataFrame:
    """Rows up to the end of their chain; `overlong` comes from `beyond_end`.

    An attempt ends by its own pages: one that failed does not bind a later one.
    """
    joined = judged.join(overlong, ATTEMPT_KEY, "left")
    return joined.where(
        F.col("cutoff").isNull() | (F.col("chain_pos") <= F.col("cutoff"))
    ).drop("cutoff")


def page_chain_prefix(pages: DataFrame, first_model: str = S.MODELS[0]) -> DataFrame:
    """Landed pages that count, judged; ends are found without reading any body."""
    judged = with_disposition(pages, first_model)
    return within_chain(judged, beyond_end(chain_outcomes(judged)))


def user_outcomes(outcomes: DataFrame) -> DataFrame:
    """Per mailbox: the worst outcome of its chains (failed, open, skipped, complete), each by its latest attempt."""
    outcomes = outcomes.groupBy(*S.CHAIN_KEY).agg(F.max_by("outcome", "attempt").alias("outcome"))
    names = F.array(*[F.lit(name) for name in (COMPLETE, SKIPPED, OPEN, FAILED)])
    rank = F.array_position(names, F.col("outcome")).cast("int")
    worst = outcomes.groupBy("mailbox").agg(F.max(rank).alias("__rank"))
    return worst.select("mailbox", F.element_at(names, F.col("__rank")).alias("outcome"))


def completed_users(outcomes: DataFrame) -> DataFrame:
    """Mailboxes to be marked done: those whose chains ended, and those skipped."""
    return user_outcomes(outcomes).where(F.col("outcome").isin(COMPLETE, SKIPPED))
