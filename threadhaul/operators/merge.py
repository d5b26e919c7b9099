"""Keyed changes of a table, each as one set-based step.

Every function returns the resulting rows (or the rows to append); storing
them is left to `tables`, which never overwrites what is being read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import dedupe_first_wins, dedupe_last_wins


# Sides of a join are named, because a source may be derived from its target.
_TARGET, _SOURCE = "target", "source"


def _col(side: str, name: str) -> Column:
    return F.col(f"{side}.`{name}`")


def _same_key(df: DataFrame, keys: Sequence[str], collation: str | None) -> Column:
    """Equality on all keys; text keys may use a collation (e.g. to ignore case)."""
    types = dict(df.dtypes)
    condition = F.lit(True)
    for name in keys:
        target, source = _col(_TARGET, name), _col(_SOURCE, name)
        if collation is not None and types[name] == "string":
            target, source = F.collate(target, collation), F.collate(source, collation)
        condition &= target == source
    return condition


def _one_per_key(
    keep: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame],
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    collation: str | None,
) -> DataFrame:
    """Deduplicate by key, text keys being compared under the collation."""
    if collation is None:
        return keep(df, keys, order)
    types = dict(df.dtypes)
    folded = {
        f"__key_{name}": F.collate(F.col(name), collation)
        for name in keys
        if types[name] == "string"
    }
    by = [f"__key_{name}" if f"__key_{name}" in folded else name for name in keys]
    return keep(df.withColumns(folded), by, order).drop(*folded)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    collation: str | None = None,
) -> DataFrame:
    """The target after the upsert: matched rows get all source values, NULLs too.

    Of several source rows for one key the last in `order` counts. After that
    both sides are unique by key, so one full outer join reads each side once
    and no key can be hot.
    """
    latest = _one_per_key(dedupe_last_wins, source, keys, order, collation)
    latest = latest.select(*target.columns, F.lit(True).alias("__found"))
    joined = target.alias(_TARGET).join(
        latest.alias(_SOURCE), _same_key(target, keys, collation), "full_outer"
    )
    found = _col(_SOURCE, "__found").isNotNull()

    def merged(name: str) -> Column:
        old, new = _col(_TARGET, name), _col(_SOURCE, name)
        return F.coalesce(old, new) if name in keys else F.when(found, new).otherwise(old)

    return joined.select(*[merged(name).alias(name) for name in target.columns])


def new_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], collation: str | None = None
) -> DataFrame:
    """Source rows whose key the target does not have; only the target's keys are read."""
    known = target.select(*keys).alias(_TARGET)
    return source.alias(_SOURCE).join(known, _same_key(source, keys, collation), "left_anti")


def merge_insert_only(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    collation: str | None = None,
) -> DataFrame:
    """The rows to append: the first of each key that the target does not have.

    Rows of the target never change. The join runs on the partitioning the
    deduplication made, so the source is shuffled once.
    """
    first = _one_per_key(dedupe_first_wins, source, keys, order, collation)
    return new_rows(target, first, keys, collation).select(*target.columns)


def dml_append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def dml_update_by_key(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The target with all columns of the changed rows replaced; unknown keys add nothing."""
    latest = dedupe_last_wins(changes, keys, order)
    latest = latest.select(*target.columns, F.lit(True).alias("__found"))
    joined = target.alias(_TARGET).join(
        latest.alias(_SOURCE), _same_key(target, keys, None), "left"
    )
    found = _col(_SOURCE, "__found").isNotNull()

    def updated(name: str) -> Column:
        old, new = _col(_TARGET, name), _col(_SOURCE, name)
        return old if name in keys else F.when(found, new).otherwise(old).alias(name)

    return joined.select(*[updated(name) for name in target.columns])


def dml_delete_by_key(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the given keys; keys it does not have change nothing.

    Keys given many times are brought down to one before the shuffle.
    """
    gone = doomed.select(*keys).distinct()
    return target.join(gone, list(keys), "left_anti")
