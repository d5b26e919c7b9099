"""Predicates, lookups and simple selections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_blank


def time_window_filter(df: DataFrame, column: str, start: Column | datetime, end: Column | datetime) -> DataFrame:
    """Rows strictly inside the window; both ends and NULL are left out."""
    return df.where((F.col(column) > F.lit(start)) & (F.col(column) < F.lit(end)))


def filter_null_or_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def message_problem(mailbox: Column, chat_id: Column, message_id: Column) -> Column:
    """Why a message must not be stored; NULL when it may.

    Chat and message ids may be empty, but not missing.
    """
    return (
        F.when(is_blank(mailbox), "mailbox")
        .when(chat_id.isNull(), "chatId")
        .when(message_id.isNull(), "id")
    )


def length_problem(columns: dict[str, Column], lengths: dict[str, int]) -> Column:
    """Which value is too long for its stored column; NULL when all fit."""
    found = F.lit(None).cast("string")
    for name, most in lengths.items():
        found = F.coalesce(found, F.when(F.length(columns[name]) > most, F.lit(f"{name} is longer than {most}")))
    return found


def validate_messages(df: DataFrame, mailbox: str, chat_id: str, message_id: str) -> DataFrame:
    """Add `problem`, for a run that rejects and reports."""
    return df.withColumn(
        "problem", message_problem(F.col(mailbox), F.col(chat_id), F.col(message_id))
    )


def require_valid(df: DataFrame, problem: str = "problem") -> DataFrame:
    """Fail on the first row with a problem, for a strict run."""
    checked = F.when(
        F.col(problem).isNotNull(),
        F.raise_error(F.concat(F.lit("missing "), F.col(problem))).cast("string"),
    )
    return df.where(checked.isNull()).drop(problem)


def find_all(df: DataFrame, predicate: Column | None = None, *selected: str | Column) -> DataFrame:
    """All rows, or those that satisfy the predicate, projected if asked for."""
    rows = df if predicate is None else df.where(predicate)
    return rows.select(*selected) if selected else rows


def find_first(
    df: DataFrame, key: Sequence[str], predicate: Column | None = None, *selected: str | Column
) -> DataFrame:
    """The first row in key order (a top-1, not a full sort); no row when nothing fits."""
    rows = df if predicate is None else df.where(predicate)
    first = rows.orderBy(*key).limit(1)
    return first.select(*selected) if selected else first


def lookup_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the batch of keys; Spark broadcasts the keys when small."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")
