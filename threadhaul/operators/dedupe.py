"""One row per key: the set-based form of "first write wins" and "last write wins".

The row-number filter is planned with a partial limit before the shuffle: each
map task sends at most one row per key, so a key that holds a large share of
the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANK = "__rank"


def _keep_one(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn(
        _RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


def dedupe_first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key; `order` should be total within a key."""
    return _keep_one(df, keys, [F.col(name).asc() for name in order])


def dedupe_last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of each key; `order` should be total within a key."""
    return _keep_one(df, keys, [F.col(name).desc() for name in order])
