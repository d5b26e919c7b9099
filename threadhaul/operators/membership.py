"""Which keys a bucketed table may hold: a Bloom filter in blocks of one 64-bit word.

Every key belongs to a bucket (the table's own), to one block of that bucket, and to a few
bits of the block. The filter is kept as rows (bucket, block, bits) of the blocks that have a
bit, so that it is as large as the keys that it knows, is added to by appending rows, and is
asked by a join on (bucket, block); rows of one block are united when read. A key
that it does not know is not in the table. One that it may know must be looked up there, in
the files of its bucket alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys for which a block is meant: with four bits each, one strange key in some 40 looks known.
KEYS_PER_BLOCK = 8
# Blocks a bucket has at first; there is no cost for those without a key.
BLOCKS = 1 << 20
_BITS = 4

_SCHEMA = "bucket int, block int, bits long"


def bucket_number(keys: Sequence[str], buckets: int) -> Column:
    """The bucket that Spark puts a row in; the columns must have the types of the table."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def bucket_of_file() -> Column:
    """The bucket of the file that a row of a table lies in. A filter on it leaves whole files out."""
    return F.regexp_extract("_metadata.file_name", r"_(\d+)(?:\.[^_]*)?$", 1).cast("int")


@dataclass(frozen=True)
class Membership:
    """The filter of one table, in the folder `place`."""

    spark: SparkSession
    place: str
    keys: tuple[str, ...]
    buckets: int
    blocks: int = BLOCKS

    def placed(self, keys: DataFrame) -> DataFrame:
        """`keys` with their bucket, block and bits."""
        digest = F.xxhash64(*self.keys)
        bits = F.lit(0).cast("long")
        for i in range(_BITS):
            at = F.shiftrightunsigned(digest, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        block = F.pmod(F.shiftrightunsigned(digest, 6 * _BITS), F.lit(self.blocks)).cast("int")
        return keys.select(*self.keys, bucket_number(self.keys, self.buckets).alias("bucket"), block.alias("block"), bits.alias("bits"))

    def add(self, placed: DataFrame) -> None:
        """Learn keys; to be done before the table gets them."""
        blocks = placed.groupBy("bucket", "block").agg(F.bit_or("bits").alias("bits"))
        blocks.sortWithinPartitions("bucket", "block").write.parquet(self._addition())

    def may_hold(self, placed: DataFrame) -> DataFrame:
        """Those of the keys that the filter may know; blocks of other buckets are not read."""
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
        known = self.spark.read.schema(_SCHEMA).parquet(self.place).where(F.col("bucket").isin(touched))
        known = known.groupBy("bucket", "block").agg(F.bit_or("bits").alias("known"))
        found = placed.join(known, ["bucket", "block"])
        return found.where(F.col("known").bitwiseAND(F.col("bits")) == F.col("bits")).drop("known")

    def create(self) -> None:
        """An empty folder, which can be read."""
        self.spark.createDataFrame([], _SCHEMA).write.parquet(self._addition())

    def _addition(self) -> str:
        """A folder for each addition: several writers may be at work."""
        return f"{self.place}/added={uuid.uuid4().hex}"


def known_keys(table: DataFrame, maybe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Those of the keys `maybe` (with their bucket) that the table does hold; only files of their buckets are read."""
    touched = [r.bucket for r in maybe.select("bucket").distinct().collect()]
    here = table.where(bucket_of_file().isin(touched)).select(*keys)
    return here.join(maybe.select(*keys), list(keys), "left_semi")
