"""Free SQL text with named parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parametrized_sql(
    spark: SparkSession, text: str, args: Mapping[str, Any] | None = None, **views: DataFrame
) -> DataFrame:
    """Run SQL with bound parameters; DataFrames may be named as `{view}` in the text."""
    return spark.sql(text, args=dict(args or {}), **views)


def _scalar(rows: DataFrame, kind: str, default: Any, name: str) -> DataFrame:
    value = F.first(F.col(rows.columns[0])).cast(kind)
    return rows.limit(1).agg(F.coalesce(value, F.lit(default).cast(kind)).alias(name))


def scalar_int(rows: DataFrame, name: str = "value") -> DataFrame:
    """One row: the first value of a query as a number, 0 when it has none."""
    return _scalar(rows, "bigint", 0, name)


def scalar_datetime(rows: DataFrame, name: str = "value") -> DataFrame:
    """One row: the first value of a query as a timestamp, NULL when it has none."""
    return _scalar(rows, "timestamp", None, name)
