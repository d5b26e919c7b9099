"""Column statistics that are kept up to date from the files that were added.

For each set of added files and each column one row is kept: counts, bounds, a distinct-count sketch
(HyperLogLog) and, for whole numbers and times, a quantile sketch (KLL). Both kinds of sketches can be merged, so the statistics of a
table are those of its file sets together, and only files that are not covered yet are ever read. The rows of a set and the
names of its files are one write, so that a set counts wholly or not at all.

Where files have gone (the table was rewritten), sets that name one of them no longer hold, and all is read anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import drop_folder, folders

# Registers of the distinct-count sketches, as a power of two: a relative error of 1.04 / 2^6.
LOG_REGISTERS = 12
# Bins of equal height that a histogram has.
BINS = 64

_SETS = (
    "file string, name string, rows long, nulls long, low long, high long, bytes long, longest long, keys binary, quantiles binary"
)


def whole_number(column: Column, kind: T.DataType) -> Column | None:
    """The column as a long in its own order (times in microseconds, without a zone as UTC); None for types without one."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    return None


def sketch_columns(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row of statistics per column, all from one pass that is aggregated before its shuffle."""
    rows = rows.select(*(column.alias(name) for name, column in columns.items()))
    nothing = F.lit(None)
    structs = []
    for field in rows.schema:
        value = F.col(f"`{field.name}`")
        number = whole_number(value, field.dataType)
        size = F.octet_length(value.cast("string")) if number is None else F.lit(8)
        key = F.encode(value.cast("string"), "UTF-8") if number is None else number
        # The aggregates leave out NULL; a sketch of nothing is one that counts none.
        parts = {
            "name": F.lit(field.name),
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(value.isNull()),
            "low": nothing.cast("long") if number is None else F.min(number),
            "high": nothing.cast("long") if number is None else F.max(number),
            "bytes": F.coalesce(F.sum(F.when(value.isNotNull(), size)), F.lit(0)).cast("long"),
            "longest": F.coalesce(F.max(F.when(value.isNotNull(), size)), F.lit(0)).cast("long"),
            "keys": F.hll_sketch_agg(key, F.lit(LOG_REGISTERS)),
            "quantiles": nothing.cast("binary") if number is None else F.kll_sketch_agg_bigint(number),
        }
        structs.append(F.struct(*(column.alias(name) for name, column in parts.items())))
    return rows.agg(F.array(*structs).alias("all")).select(F.inline("all"))


@dataclass(frozen=True)
class ColumnStatistics:
    """The statistics of one table, in the folder `place`; `columns` may be expressions over its rows."""

    spark: SparkSession
    place: str
    columns: dict[str, Column]

    def update(self, table: DataFrame) -> list[str]:
        """Cover the files of `table` that no set has yet; which these are. Only the columns in question are read."""
        files, covered = {unquote(file) for file in table.inputFiles()}, set(self._files())
        if covered - files:
            drop_folder(self.spark, self.place)
            covered = set()
        new = sorted(files - covered)
        if not new:
            return []
        rows = self.spark.read.schema(table.schema).parquet(*new)
        names = self.spark.createDataFrame([(file,) for file in new], "file string")
        both = sketch_columns(rows, self.columns).unionByName(names, allowMissingColumns=True)
        kept = T._parse_datatype_string(_SETS)
        both.select(*(F.col(f.name).cast(f.dataType) for f in kept)).coalesce(1).write.parquet(f"{self.place}/added={uuid.uuid4().hex}")
        return new

    def sets(self) -> DataFrame:
        """The rows of all sets that were written wholly."""
        found = [f"{self.place}/{name}" for name in folders(self.spark, self.place)]
        return self.spark.read.schema(_SETS).parquet(*found) if found else self.spark.createDataFrame([], _SETS)

    def _files(self) -> list[str]:
        return [row.file for row in self.sets().where("file IS NOT NULL").select("file").collect()]

    def merged(self) -> DataFrame:
        """Per column: rows, nulls, low, high, bytes, longest, the sketch `keys`, distinct, and the `borders` of bins of equal height."""
        together = self.sets().where("name IS NOT NULL").groupBy("name").agg(
            *(F.sum(name).alias(name) for name in ("rows", "nulls")),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("bytes").alias("bytes"),
            F.max("longest").alias("longest"),
            F.hll_union_agg("keys").alias("keys"),
            F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
        )
        ranks = F.array(*(F.lit(i / BINS) for i in range(BINS + 1)))
        borders = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_bigint("quantiles", ranks))
        known = F.least(F.hll_sketch_estimate("keys"), F.col("rows") - F.col("nulls"))
        return together.withColumns({"distinct": known, "borders": borders}).drop("quantiles")


def estimated_anti_join(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """About how many distinct keys of one column another one lacks: `missing`, from the merged statistics of both.

    What the union of the sketches counts beyond the right one. The error is that of the union, whatever
    the result; so a small remainder of large tables is known to some percent of the tables only.
    """
    one = left.where(F.col("name") == left_name).select(F.col("keys").alias("a"))
    other = right.where(F.col("name") == right_name).select(F.col("keys").alias("b"))
    alone = other.agg(F.coalesce(F.max(F.hll_sketch_estimate("b")), F.lit(0)))
    both = one.unionByName(other.toDF("a")).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("a")), F.lit(0)).alias("together"))
    return both.select(F.greatest(F.col("together") - alone.scalar(), F.lit(0)).alias("missing"))
