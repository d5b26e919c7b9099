"""Rates sampled by the events themselves.

An interval closes at the first event that comes `least` or more after the last close, and the
next one begins there: where a close lies depends on all before it. Time is cut into chunks
many times as long as an interval. Whatever happened before, the threshold from which an event
closes lies in the first `least` of a chunk when it is entered, so that a small table tells for every such
threshold the one at the end of the chunk. These tables are walked through in the order of time, one row
per chunk, and then all chunks are cut into intervals at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch, stored

# A chunk is so many intervals long.
CHUNK = 1_000


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and running sums of the items of one chunk."""
    times, items = (np.array(batch.column(name)[row].as_py(), np.int64) for name in ("times", "items"))
    return times, np.cumsum(items)


def chunk_table(times: np.ndarray, sums: np.ndarray, start: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the events that may close first in a chunk: their time, the threshold at its end, and the items up to its last close."""
    after = np.searchsorted(times, times + least)
    ends, last = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64)
    for i in range(len(times) - 1, -1, -1):
        last[i] = i if after[i] == len(times) else last[after[i]]
    ends = times[last] + least
    first = min(len(times), int(np.searchsorted(times, start + least)) + 1)
    return times[:first], ends[:first], sums[last[:first]]


def closes(times: np.ndarray, threshold: int, least: int) -> list[int]:
    """Which events of a chunk close an interval."""
    found, at = [], int(np.searchsorted(times, threshold))
    while at < len(times):
        found.append(at)
        at = int(np.searchsorted(times, times[at] + least))
    return found


def sampled_rates(
    df: DataFrame, ts: str, by: Sequence[str] = (), least_ms: int = 100, amount: Column | None = None, chunk: int = CHUNK
) -> DataFrame:
    """(by, closed_at, items, elapsed_ms, per_second) of every interval that has closed.

    The first event of a series begins its first interval and counts in it; `items` are the events (or the
    sum of `amount`) since the last close, that at the close included. Rows without a time are left out.
    An interval that no event closes has no row.
    """
    least, width = least_ms * 1_000, least_ms * 1_000 * chunk
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(*(F.col(name) for name in by)) if by else F.struct(F.lit(0).alias("all"))
    moments = df.where(F.col(ts).isNotNull()).select(key.alias("series"), micros.alias("at"), *_amounts(amount))
    counted = F.count("*") if amount is None else F.coalesce(F.sum("amount"), F.lit(0)).cast("long")
    moments = moments.groupBy("series", "at").agg(counted.alias("n"))
    chunk_no = F.floor(F.col("at") / F.lit(width)).cast("long")
    pairs = F.array_sort(F.collect_list(F.struct("at", "n")))
    chunks = moments.groupBy("series", chunk_no.alias("chunk")).agg(pairs.alias("pairs"))
    name = F.to_json("series", {"ignoreNullFields": "false"})
    chunks = chunks.select("series", name.alias("name"), "chunk", F.col("pairs.at").alias("times"), F.col("pairs.n").alias("items"))
    chunks = stored(chunks, scratch(df.sparkSession, "rate-chunks"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                times, sums = _arrays(batch, row)
                found = chunk_table(times, sums, batch.column("chunk")[row].as_py() * width, least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").slice(row, 1), batch.column("chunk").slice(row, 1)]
                    + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in found]
                    + [pa.array([int(sums[-1])])],
                    ["name", "chunk", "firsts", "ends", "sums", "total"],
                )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, threshold, before, at_close = None, 0, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["name"] != name:
                    # The first event of all is no close: it begins the first interval, and counts in it.
                    name, threshold, before, at_close = row["name"], row["firsts"][0], 0, 0
                    begins = True
                else:
                    begins = False
                out.append((name, row["chunk"], threshold, before, at_close, begins))
                at = int(np.searchsorted(row["firsts"], threshold))
                if at < len(row["firsts"]):
                    alone = begins and row["ends"][at] == row["firsts"][at] + least
                    threshold, at_close = row["ends"][at], 0 if alone else before + row["sums"][at]
                before += row["total"]
            columns = zip(*out) if out else ([],) * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["name", "chunk", "threshold", "before", "at_close", "begins"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(len(batch)):
                times, sums = _arrays(batch, row)
                threshold, before, at_close, begins = (batch.column(c)[row].as_py() for c in ("threshold", "before", "at_close", "begins"))
                last = threshold - least
                series = batch.column("series")[row].as_py()
                for i in closes(times, threshold, least):
                    reached = before + int(sums[i])
                    if begins:
                        begins, reached = False, 0
                    else:
                        out.append((series, int(times[i]), reached - at_close, int(times[i]) - last))
                    last, at_close = int(times[i]), reached
            columns = zip(*out) if out else ([],) * 4
            kinds = (batch.schema.field("series").type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["series", "at", "items", "elapsed"])

    entered = (
        chunks.select("name", "chunk", "times", "items")
        .mapInArrow(tables, "name string, chunk long, firsts array<long>, ends array<long>, sums array<long>, total long")
        .repartition("name")
        .sortWithinPartitions("name", "chunk")
        .mapInArrow(walk, "name string, chunk long, threshold long, before long, at_close long, begins boolean")
    )
    joined = chunks.join(entered, ["name", "chunk"]).select("series", "times", "items", "threshold", "before", "at_close", "begins")
    kind = chunks.schema["series"].dataType.simpleString()
    intervals = joined.mapInArrow(cut, f"series {kind}, at long, items long, elapsed long")
    elapsed_ms = F.col("elapsed") / 1000
    return intervals.select(
        *(F.col(f"series.{name}").alias(name) for name in by),
        F.timestamp_micros("at").alias("closed_at"),
        "items",
        elapsed_ms.alias("elapsed_ms"),
        (F.col("items") / elapsed_ms * 1000).alias("per_second"),
    )


def _amounts(amount: Column | None) -> list[Column]:
    return [] if amount is None else [amount.alias("amount")]
