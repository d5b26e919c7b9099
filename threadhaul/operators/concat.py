"""Concatenation over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def string_concat_agg(
    df: DataFrame, by: Sequence[str], value: str, separator: str = ";", name: str = "joined"
) -> DataFrame:
    """The values of each group in their own order, repeated ones as often as they occur, joined into one text.

    Equal values are counted before the shuffle, so a group costs what its
    result needs. NULLs are left out.
    """
    counted = df.groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").cast("int").alias("__n"))
    run = F.array_join(F.array_repeat(F.col("__value").cast("string"), F.col("__n")), separator)
    runs = counted.withColumn("__run", F.when(F.col("__value").isNotNull(), run))
    joined = F.expr(f"listagg(__run, '{separator}') WITHIN GROUP (ORDER BY __value)")
    return runs.groupBy(*by).agg(joined.alias(name))
