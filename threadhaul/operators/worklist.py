"""Which mailboxes are still to be exported, and how far the export is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


_DONE = "__done"


def finished(progress: DataFrame, kind: str = S.PROGRESS_TYPE_USER) -> DataFrame:
    """Distinct finished ids. The distinct is pre-aggregated before its shuffle and
    leaves the partitioning the join needs."""
    of_kind = progress.where(F.col("type") == kind)
    return of_kind.select(F.col("value").alias(_DONE)).distinct()


def _folded(column: str, collation: str | None) -> Column:
    return F.collate(F.col(column), collation) if collation else F.col(column)


def resume_worklist(
    roster: DataFrame, progress: DataFrame, key: str = S.ROSTER_KEY[0], collation: str | None = None
) -> DataFrame:
    """Roster rows without a progress row of type `user`, as an anti join; ids are equal under the collation."""
    done = finished(progress)
    return roster.join(done, _folded(key, collation) == _folded(_DONE, collation), "left_anti")


def pending_count(roster: DataFrame, progress: DataFrame, key: str = S.ROSTER_KEY[0]) -> DataFrame:
    return resume_worklist(roster, progress, key).agg(F.count("*").alias("pending"))


def progress_ratio(
    worklist: DataFrame, progress: DataFrame, key: str = S.ROSTER_KEY[0]
) -> DataFrame:
    """Share of the worklist that has been finished since it was taken."""
    done = finished(progress)
    joined = worklist.join(done, F.col(key) == F.col(_DONE), "left")
    return joined.agg(
        F.avg(F.col(_DONE).isNotNull().cast("double")).alias("ratio"),
        F.count(_DONE).alias("finished"),
        F.count("*").alias("total"),
    )


def progress_commit(
    progress: DataFrame, users: DataFrame, key: str, collation: str | None = None
) -> DataFrame:
    """Progress rows to append for the users; those already recorded are left out."""
    rows = users.select(
        F.lit(S.PROGRESS_TYPE_USER).alias("type"), F.col(key).alias("value")
    ).distinct()
    known = progress.select(F.col("type").alias("__type"), F.col("value").alias("__value"))
    same = (F.col("type") == F.col("__type")) & (_folded("value", collation) == _folded("__value", collation))
    return rows.join(known, same, "left_anti").select("type", "value")
