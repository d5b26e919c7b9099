"""Jaccard join of documents on word shingles, by parity sketches.

Sketches. Every shingle is hashed to one of k blocks, and a block holds the XOR of its
shingles' hashes: one shingle more or less changes one block, so that the number of
unlike blocks is at most the symmetric difference of two sets. Two sets of sizes
a <= b with Jaccard similarity of at least 0.8 differ in at most (a + b) / 9 <= a / 4
shingles, and b <= a * 5 / 4. Sizes are cut into bands; for the pairs whose smaller set is in a
band, at most D shingles differ, and with k = D + 1 + s blocks at least 1 + s blocks
are equal (pigeonhole). Equal blocks of two documents are found by their value.

Blocks without shingles say nothing and would be shared by everyone. A document with at most
s of them is regular: any partner shares a filled block. An irregular one also
writes the blocks of a second partition of the hashes, and so on; after the last one, its empty
blocks as well. Whatever two partners are, there is a partition in which they meet.

Pairs. Blocks are aggregated before the shuffle to their smallest document and their count; only
those of two documents or more are joined back (through a filter of fixed size).
First, each document meets the smallest one of each of its blocks, and the most similar by a
1,024-bit parity sketch, whose Hamming distance is at most the symmetric difference, is verified on
the texts. What is linked then is one component. Second, only blocks that hold several
components are looked at again: their documents outside the block's largest component meet all
others of another component. Blocks of over `heavy` documents need this only for documents with so
many heavy blocks that no light one need be shared: at least 1 + s less the empty ones. Those (texts that
consist of common passages, mostly) meet by single shingles, again in light groups first; documents of whose
shingles four fifths occur in over `heavy` others meet by these, where sizes and counts allow it.
So groups of copies cost a pair each, not all pairs, and no link between components is lost.

Defined results: a NULL or empty text has no shingles and is linked with nothing; its component is
its own id. Rows with equal id are told apart. A NULL id takes part in links, but no component is
named after it; a component of such rows alone has a NULL id. Sets are told apart by 128 bits, and
compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .words import Words, mixed, sliced, windows

SHINGLE = 5
SKETCH_BITS = 1024
SEEDS = 4
_CODE_BITS = 12  # of a block's value: the band and the partition that it belongs to
_SMALLEST = 4  # sets of fewer shingles are similar only if equal


@dataclass(frozen=True)
class Settings:
    heavy: int = 8
    block_filter_bits: int = 26
    document_filter_bits: int = 24


@lru_cache(maxsize=1)
def bands(up_to: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: smallest and largest size that takes part, number of blocks, spare blocks."""
    low, high, blocks, spare = [], [], [], []
    start = _SMALLEST
    while start < up_to:
        end = start * 5 // 4 + 1  # first size of the next band
        most = (end - 1) // 4
        s = -(-15 * (most + 1) // 100) + 2
        low.append(start)
        high.append((end - 1) * 5 // 4)
        blocks.append(most + 1 + s)
        spare.append(s)
        start = end
    return tuple(np.array(x, np.int64) for x in (low, high, blocks, spare))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows of a batch, row by row and sorted, and where each row begins."""
    words = Words(column, lower=True)
    hashes, counts, first = words.hashes(), words.counts, words.first
    many = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(begin[-1], np.uint64)
    rows = np.repeat(np.arange(len(counts)), many)
    place = first[rows] + np.arange(len(out)) - begin[rows]
    full = counts[rows] >= SHINGLE
    if full.any():
        out[full] = windows(hashes, SHINGLE)[place[full]]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        out[begin[i]] = windows(hashes[first[i] : first[i + 1]], int(counts[i]))[0]
    for i in range(len(counts)):
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    total = np.concatenate(([0], np.cumsum(new)))
    return out[new], total[begin]


def _per_row(values: np.ndarray, begin: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """`ufunc` reduced over each row; 0 for empty ones."""
    out = np.zeros(len(begin) - 1, values.dtype)
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    if len(filled):
        out[filled] = ufunc.reduceat(values, begin[filled])
    return out


def parity_sketches(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One bit flipped per shingle, of SKETCH_BITS; rows by 64-bit words."""
    n, words = len(begin) - 1, SKETCH_BITS // 64
    spot = mixed(sets + np.uint64(7))
    rows = np.repeat(np.arange(n), np.diff(begin))
    where = rows * words + (spot % np.uint64(words)).astype(np.int64)
    out = np.zeros(n * words, np.uint64)
    np.bitwise_xor.at(out, where, np.uint64(1) << ((spot >> np.uint64(32)) % np.uint64(64)))
    return out.reshape(n, words)


def _partition(sets: np.ndarray, size: np.ndarray, chosen: np.ndarray, starts: np.ndarray, band: int, seed: int):
    """Blocks of the chosen rows under one partition: values, whether they are filled, and per row the empty ones."""
    k = int(bands()[2][band])
    salted = mixed(sets ^ mixed(np.array([band * SEEDS + seed + 1], np.uint64)))
    rows = np.repeat(np.arange(len(chosen)), size[chosen])
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
    at = np.repeat(starts[chosen], size[chosen]) + inside
    own = salted[at]
    block = rows * k + ((own >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    values = np.zeros(len(chosen) * k, np.uint64)
    np.bitwise_xor.at(values, block, own)
    filled = np.bincount(block, minlength=len(values)) > 0
    code = np.uint64(band * SEEDS + seed)
    number = np.tile(np.arange(k, dtype=np.uint64), len(chosen))
    with np.errstate(over="ignore"):
        keys = mixed(values + mixed(number + code * np.uint64(1 << 40)))
    keys = (keys & ~np.uint64((1 << _CODE_BITS) - 1)) | code
    return keys.reshape(-1, k), filled.reshape(-1, k)


def block_keys(sets: np.ndarray, begin: np.ndarray) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """Per row the values of its blocks, and (code, filled blocks a partner must share) of each partition written."""
    size = np.diff(begin)
    low, high, blocks, spare = bands()
    keys: list[list[np.ndarray]] = [[] for _ in size]
    left: list[list[tuple[int, int]]] = [[] for _ in size]
    if not len(size):
        return [], left
    last = int(np.searchsorted(low, size.max(), side="right"))
    for band in range(last):
        chosen = np.flatnonzero((size >= low[band]) & (size <= high[band]))
        for seed in range(SEEDS):
            if not len(chosen):
                break
            # Only the shingles of these rows are hashed anew.
            part_size = size[chosen]
            part_begin = np.concatenate(([0], np.cumsum(part_size)))
            at = np.repeat(begin[chosen] - part_begin[:-1], part_size) + np.arange(part_begin[-1])
            found, filled = _partition(sets[at], part_size, np.arange(len(chosen)), part_begin[:-1], band, seed)
            empty = (~filled).sum(axis=1)
            irregular = empty > spare[band]
            for i, row in enumerate(chosen):
                write = filled[i]
                if irregular[i] and seed == SEEDS - 1:
                    write = np.ones_like(write)
                keys[row].append(found[i][write])
                left[row].append((band * SEEDS + seed, int(1 + spare[band] - empty[i])))
            chosen = chosen[irregular]
    none = np.zeros(0, np.uint64)
    return [np.concatenate(x) if x else none for x in keys], left


_SKETCHED = (
    "node long, n_shingles long, d1 long, d2 long, sketch array<long>, codes array<int>, needs array<int>, keys array<long>"
)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))


def _key_lists(keys: list[np.ndarray], left: list[list[tuple[int, int]]]) -> list[pa.ListArray]:
    """The columns codes, needs, keys."""
    codes, needs = ([np.array([x[i] for x in row], np.int32) for row in left] for i in (0, 1))
    return [_lists(codes, pa.int32()), _lists(needs, pa.int32()), _lists([x.view(np.int64) for x in keys], pa.int64())]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        sets, begin = shingle_sets(batch.column("text"))
        with np.errstate(over="ignore"):
            d1 = _per_row(mixed(sets), begin, np.add)
            d2 = _per_row(mixed(sets + np.uint64(5)), begin, np.add)
        keys, left = block_keys(sets, begin)
        sketches = parity_sketches(sets, begin).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                pa.array(np.diff(begin), pa.int64()),
                pa.array(d1.view(np.int64)),
                pa.array(d2.view(np.int64)),
                _lists(list(sketches), pa.int64()),
                *_key_lists(keys, left),
            ],
            [x.split()[0] for x in _SKETCHED.split(", ")],
        )


class BitFilter:
    """A set of 64-bit values as a bit field of fixed size: may hold more, never less."""

    def __init__(self, values: DataFrame, column: str, bits: int):
        self.bits = bits
        slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
        masks = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
        filled = values.select(
            F.shiftright(slot, 6).cast("int").alias("word"), F.get(masks, slot.bitwiseAND(F.lit(63)).cast("int")).alias("mask")
        )
        words = filled.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        field = np.zeros(1 << (bits - 6), np.int64)
        field[words.column("word").to_numpy()] = words.column("mask").to_numpy()
        self.shared = values.sparkSession.sparkContext.broadcast(field)

    def may_hold(self, slots: np.ndarray) -> np.ndarray:
        field = self.shared.value.view(np.uint64)
        s = slots.astype(np.uint64) >> np.uint64(64 - self.bits)
        return (field[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows as (node, doc_id, text), a node being one row; (node, doc_id); and, where ids repeat or are NULL, (node, row).

    The id serves where it tells all rows apart; otherwise whole rows are stored with numbers of their own.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    unclear = docs.groupBy(doc_id.alias("doc_id")).count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not unclear:
        plain = docs.select(doc_id.alias("node"), doc_id.alias("doc_id"), text.alias("text"))
        return plain.select("node", "text"), plain.select("node", "doc_id"), None
    rows = keep(docs.select(F.monotonically_increasing_id().alias("node"), F.struct("*").alias("row")), "numbered")
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return rows.select("node", text.alias("text")), rows.select("node", doc_id.alias("doc_id")), rows


def _changed(a: DataFrame, b: DataFrame) -> bool:
    return bool(a.join(b.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b); label is the smallest node of the component.

    Labels fall to the smallest of the neighbours, then to the label of the label, until none changes.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        lower = keep(
            labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label")), "labels"
        )
        jump = lower.select(F.col("node").alias("of"), F.col("label").alias("further"))
        after = keep(
            lower.join(jump, F.col("label") == F.col("of")).select("node", F.least("label", "further").alias("label")), "labels"
        )
        if not _changed(after, labels):
            return after
        labels = after


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _plausible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave a similarity of 0.8 possible, with their Hamming distance."""
    one = sketched.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = sketched.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .where("100 * least(na, nb) >= 80 * greatest(na, nb)")
        .select("a", "b", "na", "nb", hamming(F.col("sa"), F.col("sb")).alias("distance"))
        .where("9 * distance <= na + nb")
        .select("a", "b", "distance")
    )


@lru_cache(maxsize=64)
def _one_set(text: str) -> np.ndarray:
    return shingle_sets(pa.array([text]))[0]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for left, right in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
            x, y = _one_set(left), _one_set(right)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that are linked, by their texts. Only texts of some pair are shuffled."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = BitFilter(wanted, "node", settings.document_filter_bits)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_row = held.may_hold(batch.column("slot").to_numpy().view(np.uint64))
            yield batch.select(["node", "text"]).filter(pa.array(keep_row))

    texts = keep(
        nodes.select("node", "text", F.xxhash64("node").alias("slot")).mapInArrow(choose, "node long, text string"),
        "candidate-texts",
    )
    return (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_verify, "a long, b long")
    )


def _shared(sketched: DataFrame, settings: Settings) -> DataFrame:
    """(key, node, leader, n) for each block value of two nodes or more."""
    blocks = sketched.select("node", F.explode("keys").alias("key"))
    groups = keep(
        blocks.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "shared-blocks"
    )
    held = BitFilter(groups, "key", settings.block_filter_bits)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_row = held.may_hold(batch.column("slot").to_numpy().view(np.uint64))
            yield batch.select(["node", "key"]).filter(pa.array(keep_row))

    rows = blocks.select("node", "key", F.xxhash64("key").alias("slot")).mapInArrow(choose, "node long, key long")
    return rows.join(groups, "key")


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, n) of the blocks with documents of several components."""
    named = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = (
        named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    )
    return keep(named.join(several.select("key", "n"), "key"), "mixed-blocks")


def _minor(rows: DataFrame) -> DataFrame:
    """`rows` of blocks with several components; `minor` outside the block's largest one."""
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels"))
    return rows.join(largest.where("labels > 1"), "key").withColumn("minor", F.col("label") != F.col("largest"))


def _light_pairs(mixed_rows: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of unlike components in blocks of at most `heavy` documents."""
    rows = _minor(mixed_rows.where(F.col("n") <= settings.heavy).drop("n"))
    one = rows.where("minor").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
    two = rows.select("key", F.col("node").alias("y"), F.col("label").alias("ly"))
    return one.join(two, "key").where("lx <> ly").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _irregular(mixed_rows: DataFrame, sketched: DataFrame, settings: Settings) -> DataFrame:
    """Documents that need not share a light block with a partner."""
    code = F.col("key").bitwiseAND(F.lit((1 << _CODE_BITS) - 1)).cast("int")
    needs = sketched.select("node", F.explode(F.arrays_zip("codes", "needs")).alias("x")).select(
        "node", F.col("x.codes").alias("code"), F.col("x.needs").alias("needs")
    )
    return (
        mixed_rows.where(F.col("n") > settings.heavy)
        .groupBy("node", code.alias("code"))
        .agg(F.count("*").alias("heavy"))
        .join(needs, ["node", "code"])
        .where("heavy >= needs")
        .select("node")
        .distinct()
    )


def _shingles(nodes: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """The sets of the wanted documents (and of a few others, which does no harm), one shingle a block."""
    held = BitFilter(wanted, "node", settings.document_filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(pa.array(held.may_hold(batch.column("slot").to_numpy().view(np.uint64))))
            for part in sliced([chosen], "text"):
                sets, begin = shingle_sets(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(np.diff(begin), pa.int64()), lists], ["node", "n_shingles", "keys"]
                )

    return nodes.select("node", "text", F.xxhash64("node").alias("slot")).mapInArrow(
        run, "node long, n_shingles long, keys array<long>"
    )


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) * 20).cast("int")


def _heavy_pairs(mixed_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that have only shingles of over `heavy` documents in common.

    With h heavy ones of its n shingles, a document has a partner of size m only if
    9 h >= 4 (n + m), and the partner likewise; partners are met by their size class. The document
    of the smaller component looks for the other. As at least 4 n / 5 of its shingles must be shared,
    it looks under its h - 4 n / 5 + 1 rarest heavy ones only. Both know their heavy shingles in one
    order, by rarity, so that what is left behind a shingle bounds what they can still share.
    """
    counted = (
        mixed_rows.groupBy("node").agg(F.count("*").alias("h"))
        .join(sets.select("node", F.col("n_shingles").alias("size")), "node")
        .where("10 * h >= 8 * size")
    )
    rows = mixed_rows.join(counted, "node")
    members = rows.select("node", "label").distinct().groupBy("label").agg(F.count("*").alias("members"))
    rarest = Window.partitionBy("node").orderBy("n", "key")
    rows = keep(
        rows.join(members, "label").select(
            "key", "node", "h", "size", F.struct("members", "label").alias("component"), F.row_number().over(rarest).alias("place")
        ),
        "heavy-shingles",
    )
    top = rows.groupBy("key").agg(F.max("component").alias("top"))
    low = F.col("size") * 0.8 * 0.999
    high = F.least(F.col("size") * 1.25, F.col("h") * 2.25 - F.col("size")) * 1.001
    one = (
        rows.where(F.col("place") <= F.col("h") - F.ceil(F.col("size") * 4 / 5) + 1)
        .join(top, "key")
        .where("component < top")
        .select(
            "key",
            F.explode(F.sequence(_size_class(low), F.greatest(_size_class(low), _size_class(high)))).alias("class"),
            F.col("node").alias("x"),
            F.col("component").alias("cx"),
            F.col("h").alias("hx"),
            F.col("size").alias("nx"),
            F.col("place").alias("px"),
        )
    )
    two = rows.select(
        "key",
        _size_class(F.col("size")).alias("class"),
        F.col("node").alias("y"),
        F.col("component").alias("cy"),
        F.col("h").alias("hy"),
        F.col("size").alias("ny"),
        F.col("place").alias("py"),
    )
    # Under their first common shingle, enough must be left on both sides.
    left = "least(hx - px, hy - py) + 1"
    return (
        one.join(two, ["key", "class"])
        .where(f"cx < cy AND 9 * ({left}) >= 4 * (nx + ny)")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _second_pairs(
    nodes: DataFrame, shared: DataFrame, labels: DataFrame, sketched: DataFrame, again: DataFrame, settings: Settings
) -> DataFrame:
    """Pairs (a, b) of unlike components that may be linked and that the first round need not have met."""
    coarse = _mixed(shared, labels)
    irregular = keep(_irregular(coarse, sketched, settings), "irregular")
    sets = keep(_shingles(nodes, irregular, settings).join(again, "node", "left_anti"), "irregular-sets")
    close = _mixed(_shared(sets, settings), labels)
    return _light_pairs(coarse, settings).union(_light_pairs(close, settings)).union(_heavy_pairs(close.where(F.col("n") > settings.heavy), sets)).distinct()


def _labelled(nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all nodes; (node, label) of the linked ones, label being the smallest node of the component; and the links (a, b)."""
    sketched = keep(nodes.mapInArrow(_sketch, _SKETCHED), "sketches")
    # Equal sets need no comparison: the smallest node stands for them.
    # Stored, so that the join behind it may be split where one set has very many copies.
    equal = keep(
        sketched.where("n_shingles > 0")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min("node").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1"),
        "equal-classes",
    )
    copies = keep(
        sketched.where("n_shingles > 0")
        .select("node", "d1", "d2", "n_shingles")
        .join(equal, ["d1", "d2", "n_shingles"])
        .where("node <> first")
        .select(F.col("first").alias("a"), F.col("node").alias("b")),
        "equal-sets",
    )
    again = copies.select(F.col("b").alias("node"))
    shared = keep(_shared(sketched, settings).join(again, "node", "left_anti"), "shared-rows")
    small = sketched.select("node", "n_shingles", "sketch")
    # First round: of the smallest nodes of its blocks, each document meets the most similar one.
    stars = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    best = (
        _plausible(stars, small).groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b")
    )
    links = keep(verified(keep(best, "first-pairs"), nodes, settings), "first-links")
    labels = components(links)
    second = keep(_plausible(_second_pairs(nodes, shared, labels, sketched, again, settings), small).select("a", "b"), "second-pairs")
    more = keep(verified(second, nodes, settings), "second-links")
    edges = links.union(more).union(copies)
    return sketched, components(edges), edges


def jaccard_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, and links, how many of the links that were needed to find it end there.

    These are verified links and those to the first of equal sets. They span the component; further links inside it are not
    enumerated.
    """
    nodes, ids, _ = _numbered(docs)
    sketched, named, edges = _labelled(nodes, settings)
    least = (
        named.join(ids, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    )
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    found = named.join(least, "label").join(ends, "node").select("node", "component_id", "links")
    return (
        sketched.select("node", "n_shingles")
        .join(ids, "node")
        .join(found, "node", "left")
        .select(
            "node",
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("links", F.lit(0)).alias("links"),
        )
    )


def one_per_component(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, of equal ones any single one.

    Components are told apart by their rows, not by their ids: unlinked rows stay, also those whose id is
    that of another row. Rows without id stay.
    """
    nodes, ids, rows = _numbered(docs)
    _, named, _ = _labelled(nodes, settings)
    linked = named.join(ids, "node").where("doc_id IS NOT NULL")
    first = linked.groupBy("label").agg(F.min(F.struct("doc_id", "node"))["node"].alias("first"))
    gone = keep(linked.join(first, "label").where("node <> first").select(F.col("node").alias("gone")), "duplicate-rows")
    if rows is None:
        return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
    return rows.join(gone, F.col("node") == F.col("gone"), "left_anti").select("row.*")
