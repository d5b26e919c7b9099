"""Centroid clustering with heap-ordered bounds, in whole numbers.

Vectors lie in blocks of a few thousand, in a table that is bucketed by block. Each block has, for
every centroid, a heap of its vectors by the gap between a lower bound of their distance to the
second-nearest centroid and an upper bound of that to their own. When centroids move, a gap shrinks
by at most what its own centroid moved plus the most that any other moved; these sums are
accumulated per centroid, and a gap is stored plus the sum at that time. So the vectors whose gap may have
closed are those at the top of the heap, at or below the sum of today: only they are popped, and
compared with all centroids anew; all others keep their centroid without being looked at.

A round is one pass over the blocks, joined with their states (assignment and heaps, some 14 bytes a
vector): only the states are shuffled, the vectors are read where they lie. Tasks hand back how the
sums of the centroids change through the vectors that changed over; k * (dimensions + 1) numbers
reach the driver, whatever the number of vectors. States are written to the shared folder after each round.

All distances and means are exact. Bounds are roots in double precision, kept apart by a margin wider
than their errors; a gap of zero is popped too, so that ties go to the smaller number.

Defined results: vectors with another number of components, or with a NULL, NaN or infinite one, are
left out, as are those with a component of 2^19 or more, whose squared distances need not fit a long;
vectors without id are hashed as without one, and several with one id are vectors each (in the order of
their components where they are among the first); with fewer vectors than centroids, each is one; an
empty table gives no rows. A sum of distances that does not fit a long is NULL.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch
from .common import keep

# Components below this give squared distances below 2^62.
_COMPONENT = 1 << 27
# Relative width of the margin that makes up for roots in double precision.
_MARGIN = 1e-12


@dataclass(frozen=True)
class Clustering:
    """Components are floor(scale * x). `seed` is the text before the id whose hash picks the first centroids."""

    dimensions: int = 64
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    seed: str = "2:"
    block_rows: int = 2_048
    blocks_per_bucket: int = 64


def valid_vectors(df: DataFrame, how: Clustering, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and vector (whole numbers) of every row that has a vector of the right kind."""
    values = F.col(vector_column).cast("array<double>")
    # NaN is above every number.
    good = (F.size(values) == how.dimensions) & F.forall(
        values, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(_COMPONENT // how.scale)))
    )
    whole = F.transform(values, lambda x: F.floor(x * F.lit(float(how.scale))).cast("int"))
    return df.where(good).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, how: Clustering) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(how.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("digest", digest).orderBy("digest", "vector").limit(how.clusters).collect()
    return np.array([r.vector for r in rows], np.int64).reshape(len(rows), how.dimensions)


def _blocks(vectors: DataFrame, how: Clustering) -> DataFrame:
    """block, ids and components (bytes), `block_rows` vectors in each but the last of a task."""
    width = how.block_rows

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, none, values, held, made = [], [], [], 0, TaskContext.get().partitionId() << 32

        def out(n: int) -> pa.RecordBatch:
            nonlocal ids, none, values, held, made
            all_ids, all_none, all_values = np.concatenate(ids), np.concatenate(none), np.concatenate(values)
            ids, none, values, held = [all_ids[n:]], [all_none[n:]], [all_values[n:]], held - n
            made += 1
            parts = (all_ids[:n].tobytes(), np.packbits(all_none[:n]).tobytes(), all_values[:n].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([made - 1]), pa.array([n]), *(pa.array([part], pa.binary()) for part in parts)],
                ["block", "n", "ids", "no_id", "components"],
            )

        for batch in batches:
            column = batch.column("vec_id")
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            none.append(column.is_null().to_numpy(zero_copy_only=False))
            values.append(batch.column("vector").flatten().to_numpy().astype("<i4").reshape(-1, how.dimensions))
            held += len(batch)
            while held >= width:
                yield out(width)
        if held:
            yield out(held)

    return vectors.mapInArrow(packed, "block long, n long, ids binary, no_id binary, components binary")


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact, as whole numbers: by double precision where all sums stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


class Heaps:
    """Assignment of the vectors of one block, and per centroid a heap of (gap + sum of drifts, place)."""

    def __init__(self, clusters: int, assigned: np.ndarray, keys: np.ndarray, order: np.ndarray):
        self.assigned, self.heaps, at = assigned, [], 0
        for size in np.bincount(assigned, minlength=clusters) if len(order) else [0] * clusters:
            self.heaps.append(list(zip(keys[at : at + size].tolist(), order[at : at + size].tolist())))
            at += size

    @classmethod
    def unpacked(cls, clusters: int, state: bytes | None, n: int) -> Heaps:
        if state is None:
            return cls(clusters, np.full(n, -1, np.int16), np.zeros(0), np.zeros(0, np.int32))
        keys, order = np.frombuffer(state, "<f8", n), np.frombuffer(state, "<i4", n, 8 * n)
        return cls(clusters, np.frombuffer(state, "<i2", n, 12 * n).copy(), keys, order)

    def packed(self) -> bytes:
        """Heaps in the order they have, so that they are heaps again when read."""
        pairs = [pair for heap in self.heaps for pair in heap]
        keys, order = np.array([k for k, _ in pairs], "<f8"), np.array([i for _, i in pairs], "<i4")
        return keys.tobytes() + order.tobytes() + self.assigned.astype("<i2").tobytes()

    def expired(self, drifts: np.ndarray) -> np.ndarray:
        """Pops the vectors whose gap may have closed; all, when none has been assigned yet."""
        if len(self.assigned) and self.assigned[0] < 0:
            return np.arange(len(self.assigned))
        out = []
        for heap, drift in zip(self.heaps, drifts.tolist()):
            while heap and heap[0][0] <= drift:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def rescan(self, places: np.ndarray, x: np.ndarray, centroids: np.ndarray, drifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compares these vectors with all centroids; their centroids before and after."""
        found = squared_distances(x[places], centroids)
        nearest = found.argmin(axis=1)
        rows = np.arange(len(places))
        upper = np.sqrt(found[rows, nearest].astype(np.float64))
        if found.shape[1] > 1:
            found[rows, nearest] = np.iinfo(np.int64).max
            lower = np.sqrt(found.min(axis=1).astype(np.float64))
        else:
            lower = np.full(len(places), np.inf)
        sums = drifts[nearest]
        with np.errstate(invalid="ignore"):
            keys = np.where(np.isinf(lower), np.inf, lower - upper + sums - _MARGIN * (lower + upper + sums + 1))
        before = self.assigned[places]
        self.assigned[places] = nearest
        for key, place, cluster in zip(keys.tolist(), places.tolist(), nearest.tolist()):
            heapq.heappush(self.heaps[cluster], (key, place))
        return before, nearest


def change_of_sums(x: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> np.ndarray:
    """Per centroid, what its number of vectors and the sums of their components change by."""
    change = np.zeros((clusters, x.shape[1] + 1), np.int64)
    moved = before != after
    rows = np.hstack([np.ones((int(moved.sum()), 1), np.int64), x[moved].astype(np.int64)])
    np.add.at(change, after[moved].astype(np.int64), rows)
    left = before[moved] >= 0
    np.subtract.at(change, before[moved][left].astype(np.int64), rows[left])
    return change


def _components(batch: pa.RecordBatch, row: int, dimensions: int) -> np.ndarray:
    return np.frombuffer(batch.column("components")[row].as_py(), "<i4").reshape(-1, dimensions)


def _round(blocks: DataFrame, states: DataFrame | None, centroids: np.ndarray, drifts: np.ndarray) -> DataFrame:
    """One assignment of all vectors: per block its new state, the vectors rescanned, and the changes of the sums."""
    clusters, dimensions = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                x = _components(batch, row, dimensions)
                heaps = Heaps.unpacked(clusters, batch.column("state")[row].as_py(), len(x))
                places = heaps.expired(drifts)
                before, after = heaps.rescan(places, x, centroids, drifts)
                change = change_of_sums(x[places], before, after, clusters)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(row, 1),
                        pa.array([heaps.packed()], pa.binary()),
                        pa.array([len(places)]),
                        pa.array([change.astype("<i8").tobytes() if change.any() else None], pa.binary()),
                    ],
                    ["block", "state", "rescanned", "change"],
                )

    if states is None:
        joined = blocks.select("block", "components", F.lit(None).cast("binary").alias("state"))
    else:
        joined = blocks.select("block", "components").join(states.hint("shuffle_hash"), "block").select("block", "components", "state")
    return joined.mapInArrow(assign, "block long, state binary, rescanned long, change binary")


def _changes(states: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """The changes of all blocks, summed by place in the tasks first."""
    width = dimensions + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clusters * width, np.int64)
        for batch in batches:
            for change in batch.column("change").to_pylist():
                total += np.frombuffer(change, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "value"])

    found = states.select("change").where("change IS NOT NULL").mapInArrow(summed, "place int, value long")
    out = np.zeros(clusters * width, np.int64)
    for r in found.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out.reshape(clusters, width)


def moved_centroids(centroids: np.ndarray, sums: np.ndarray, drifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floors of the means (an empty cluster stays), and the drifts with this move added."""
    after = centroids.copy()
    full = sums[:, 0] > 0
    after[full] = sums[full, 1:] // sums[full, :1]
    # Python's whole numbers: squares of long moves need not fit 64 bits.
    moves = np.array([math.sqrt(sum(d * d for d in row)) for row in (after - centroids).tolist()]) * (1 + _MARGIN)
    others = [max((m for j, m in enumerate(moves.tolist()) if j != i), default=0.0) for i in range(len(moves))]
    return after, (drifts + moves + np.array(others)) * (1 + _MARGIN)


def _assignments(blocks: DataFrame, states: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector: vec_id, cluster and distance."""
    dimensions = centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                x = _components(batch, row, dimensions).astype(np.int64)
                n = len(x)
                ids = np.frombuffer(batch.column("ids")[row].as_py(), "<i8")
                none = np.unpackbits(np.frombuffer(batch.column("no_id")[row].as_py(), np.uint8), count=n).astype(bool)
                assigned = np.frombuffer(batch.column("state")[row].as_py(), "<i2", n, 12 * n).astype(np.int32)
                away = ((x - centroids[assigned]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=none), pa.array(assigned), pa.array(away)], ["vec_id", "cluster", "distance"]
                )

    joined = blocks.join(states.select("block", "state").hint("shuffle_hash"), "block")
    return joined.select("ids", "no_id", "components", "state").mapInArrow(rows, "vec_id long, cluster int, distance long")


@dataclass
class Clustered:
    """rescanned: vectors compared with all centroids, per round (the last one included)."""

    assignments: DataFrame
    centroids: np.ndarray
    rescanned: list[int]


def cluster(df: DataFrame, how: Clustering = Clustering(), id_column: str = "vec_id", vector_column: str = "embedding") -> Clustered:
    spark = df.sparkSession
    vectors = valid_vectors(df, how, id_column, vector_column)
    centroids = first_centroids(vectors, how)
    if not len(centroids):
        return Clustered(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [])
    sums = np.zeros((len(centroids), how.dimensions + 1), np.int64)
    drifts = np.zeros(len(centroids))

    buckets = -(-df.count() // (how.block_rows * how.blocks_per_bucket))
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"threadhaul_vectors_{uuid.uuid4().hex}"
    packed = _blocks(vectors, how).repartition(buckets, "block")
    packed.write.bucketBy(buckets, "block").option("path", scratch(spark, "vectors")).saveAsTable(name)
    try:
        blocks, states, rescanned = spark.table(name), None, []
        for turn in range(how.rounds + 1):
            states = keep(_round(blocks, states and states.select("block", "state"), centroids, drifts), "cluster-states")
            rescanned.append(states.agg(F.sum("rescanned")).first()[0])
            if turn < how.rounds:
                sums += _changes(states, *centroids.shape)
                centroids, drifts = moved_centroids(centroids, sums, drifts)
        return Clustered(keep(_assignments(blocks, states, centroids), "cluster-assignments"), centroids, rescanned)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_inertia(found: Clustered) -> DataFrame:
    """Assignments with cluster_inertia, inertia and the digest of the final centroid."""
    spark = found.assignments.sparkSession
    inertia = found.assignments.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()
    per_cluster = {r.cluster: r.inertia for r in inertia}
    known = None not in per_cluster.values() and sum(per_cluster.values()) < 1 << 63
    whole = sum(per_cluster.values()) if known else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    rows = [(i, per_cluster.get(i, 0), whole, digest) for i, digest in enumerate(digests)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # One row per centroid.
    return found.assignments.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
