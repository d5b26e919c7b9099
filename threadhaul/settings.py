"""Settings of an export run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import parse_bound


class SettingsError(ValueError):
    """A setting is missing or unusable; the run must not start."""


def page_size(requested: int | None) -> int:
    """The requested page size when it is in range, else the default."""
    if requested is not None and S.MIN_PAGE_SIZE <= requested <= S.MAX_PAGE_SIZE:
        return requested
    return S.DEFAULT_PAGE_SIZE


@dataclass(frozen=True)
class ExportSettings:
    """What to export and where to keep it.

    `roster_lines` reads roster files with one object per line instead of one
    array. Arrays in files above `roster_split_bytes` are split among tasks.
    `window_slices` cuts the window of each user for fetching. `groups` is the number of parts the
    worklist is worked off in: each part is stored and its users marked done before the next begins.

    `strict` makes a run fail on bad roster elements, invalid messages and
    failed users, after everything good has been stored. Otherwise they are
    reported and the users concerned stay pending.
    """

    start: str = ""
    end: str = ""
    roster_pattern: str = S.ROSTER_PATTERN
    roster_lines: bool = False
    roster_split_bytes: int = 64 << 20
    window_slices: int = 1
    groups: int = 1
    model: str = S.MODELS[0]
    page_size: int = S.DEFAULT_PAGE_SIZE
    database: str = "chat_export"
    database_location: str | None = None
    buckets: int | None = None
    key_collation: str | None = None
    strict: bool = False
    reset: bool = False

    def __post_init__(self):
        object.__setattr__(self, "page_size", page_size(self.page_size))
        if self.model not in S.MODELS:
            object.__setattr__(self, "model", S.MODELS[0])
        if not self.roster_pattern:
            raise SettingsError("the roster file pattern is missing")

    def window(self, spark: SparkSession) -> tuple[datetime, datetime]:
        """Both ends of the export window in UTC; a missing or unreadable end is an error."""
        row = spark.range(1).select(
            *[
                F.date_format(parse_bound(F.lit(text)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
                for name, text in (("start", self.start), ("end", self.end))
            ]
        ).first()
        for name in ("start", "end"):
            if row[name] is None:
                raise SettingsError(f"the {name} of the export window is missing")
        return datetime.fromisoformat(row["start"]), datetime.fromisoformat(row["end"])
