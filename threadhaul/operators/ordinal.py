"""Row numbers within groups of any size, with one shuffle of the rows.

A plain row-number window sends each group to one task. Here explicit bounds, taken
from a bounded sample of the keys, cut the rows into parts by group and order, and the
rows of each part and group are numbered by themselves. Only bounds within large groups are kept:
the rows of small ones are dealt by group as in a plain window. A group that reaches over a
bound is the group *of* that bound, so that the numbers missing are known from two
counts a part: the rows of the group of its lower bound, and those of its upper one.
They are counted in a pass over the keys alone, and come back as constants.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sampled keys for each part, and the rows below which a part is not worth its task.
SAMPLE_PER_PART = 100
PART_ROWS = 10_000


@dataclass(frozen=True)
class _Cuts:
    """The ascending lower bounds of all parts but the first; part p begins at `bounds[p - 1]`."""

    columns: tuple[tuple[str, str], ...]
    groups: int
    bounds: list[Row]

    def array(self, fields: int) -> Column:
        """The first `fields` values of each bound."""
        return F.array(
            *(
                F.struct(*(F.lit(value).cast(kind).alias(name) for (name, kind), value in zip(self.columns[:fields], bound)))
                for bound in self.bounds
            )
        )

    def part(self) -> Column:
        """How many bounds are at or below the key of a row: a binary search."""
        key, bounds, many = F.struct(*(F.col(name) for name, _ in self.columns)), self.array(len(self.columns)), len(self.bounds)
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(many.bit_length()))))
        return F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: F.when((at + step <= many) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at),
        )

    def of_bound(self, at: Column) -> Column:
        """Whether a row is of the group that bound number `at` (from 0) lies in."""
        if not self.groups:
            return (at >= 0) & (at < len(self.bounds))
        group = F.struct(*(F.col(name) for name, _ in self.columns[: self.groups]))
        return F.coalesce(F.get(self.array(self.groups), at) == group, F.lit(False))

    def shifts(self, keys: DataFrame, part: str) -> list[int]:
        """Per part, the rows that the group of its lower bound has in earlier parts."""
        counted = keys.groupBy(part).agg(F.count_if(self.of_bound(F.col(part))).alias("rows"))
        rows = {r[part]: r["rows"] for r in counted.collect()}
        shifts = [0]
        for p, bound in enumerate(self.bounds):
            goes_on = p > 0 and self.bounds[p - 1][: self.groups] == bound[: self.groups]
            shifts.append(rows.get(p, 0) + (shifts[p] if goes_on else 0))
        return shifts


def _cuts(keys: DataFrame, groups: int, parts: int, part_rows: int) -> _Cuts:
    rows = keys.count()
    parts = min(parts, -(-rows // part_rows))
    bounds: list[Row] = []
    if parts > 1:
        share = min(1.0, SAMPLE_PER_PART * parts / rows)
        sample = keys.sample(share, seed=1).orderBy(*keys.columns).collect()
        sizes = Counter(repr(row[:groups]) for row in sample)
        for i in range(1, parts):
            bound = sample[i * len(sample) // parts] if sample else None
            # A group of less than half a part needs no bound.
            if bound is not None and bound not in bounds[-1:] and 2 * parts * sizes[repr(bound[:groups])] >= len(sample):
                bounds.append(bound)
    return _Cuts(tuple(keys.dtypes), groups, bounds)


def with_ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "ordinal",
    parts: int | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Add the exact 1-based position of each row in its group, NULLs first.

    `order` should be total within a group; `group` and `order` must not change from one
    evaluation to the next. At most `parts` parts are made (twice the shuffle partitions
    if not given), and none for fewer than `part_rows` rows.
    """
    keys = df.select(*group, *order)
    parts = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(keys, len(group), parts, part_rows)
    if not cuts.bounds:
        # So few rows, or groups so small, that one task may hold any of them.
        alone = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(alone.orderBy(*order)).cast("long"))
    part = "__part"
    shifts = cuts.shifts(keys.withColumn(part, cuts.part()), part)
    placed = df.withColumn(part, cuts.part())
    local = F.row_number().over(Window.partitionBy(part, *group).orderBy(*order)).cast("long")
    earlier = F.get(F.array(*(F.lit(n).cast("long") for n in shifts)), F.col(part))
    shift = F.when(cuts.of_bound(F.col(part) - 1), earlier).otherwise(F.lit(0))
    return placed.withColumn(name, local + shift).drop(part)


def paginate(
    df: DataFrame, mailbox: str, order: Sequence[str], page_size: int
) -> DataFrame:
    """Add `page_no` and `position`, both from 0: pages of `page_size` rows per mailbox."""
    numbered = with_ordinal(df, [mailbox], order, "__ordinal")
    index = F.col("__ordinal") - 1
    return (
        numbered.withColumn("page_no", _div(index, page_size).cast("int"))
        .withColumn("position", (index % page_size).cast("int"))
        .drop("__ordinal")
    )


def rolling_series(
    df: DataFrame, order: Sequence[str], records: int, name: str = "series"
) -> DataFrame:
    """Add the 0-based number of the file each log row falls in, `records` rows per file."""
    numbered = with_ordinal(df, [], order, "__ordinal")
    return numbered.withColumn(name, _div(F.col("__ordinal") - 1, records)).drop("__ordinal")


def _div(value: Column, by: int) -> Column:
    """Whole-number division."""
    return F.call_function("div", value, F.lit(by))
