"""Moving averages over ordered series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from .ordinal import with_ordinal


def warm_start_moving_avg(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    value: str,
    samples: int = S.RATE_SAMPLES,
    name: str = "moving_avg",
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Mean of the last `samples` values, the series' first value standing in for
    the samples still missing at its start.

    A series is cut into chunks of `chunk_rows`; the last rows of a chunk are
    also given to the next one as its left margin. So a window task never holds
    more than one chunk, however long the series.
    """
    chunk_rows = max(chunk_rows, samples)
    margin = samples - 1
    index = F.col("__ordinal") - 1
    home = F.call_function("div", index, F.lit(chunk_rows))
    in_margin = index % chunk_rows >= chunk_rows - margin
    spread = (
        with_ordinal(df, series, order, "__ordinal")
        .withColumn("__home", home)
        .withColumn(
            "__chunk",
            F.explode(
                F.when(in_margin, F.array("__home", F.col("__home") + 1)).otherwise(
                    F.array("__home")
                )
            ),
        )
    )
    chunk = Window.partitionBy(*series, "__chunk").orderBy("__ordinal")
    frame = chunk.rowsBetween(-margin, 0)
    # Samples are missing in the first chunk only, whose first row starts the series.
    missing = F.greatest(F.lit(samples) - F.col("__ordinal"), F.lit(0))
    padded = F.sum(value).over(frame) + missing * F.first(value).over(
        chunk.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        spread.withColumn(name, padded / samples)
        .where(F.col("__chunk") == F.col("__home"))
        .select(*df.columns, name)
    )
