"""Rates over an unbounded log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.metrics import rate_per_window


def rate_stream(
    log: DataFrame, ts: str, duration: str, watermark: str, by: Sequence[str] = ()
) -> DataFrame:
    """Items per tumbling window of a stream; rows later than the watermark are left out."""
    return rate_per_window(log.withWatermark(ts, watermark), ts, duration, by)
