"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are lower-cased runs of letters and digits. A mask such as 11011011 laid over the
words of a text hashes only the positions with a 1, so that substituted words under a 0
do not matter. Seeds of the documents are looked up among those of the benchmark. A
filter of bounded size drops most positions inside the row that holds the text; what passes it
is joined exactly. Each hit names a document, an item and an offset between them; along that
offset the words are compared one by one, and the best segment counts (a match is
worth 1, a substitution costs `penalty`). From `least_score` on, or `short_share` of
the words of a shorter item (all of fewer than five), the document holds the item.

Defined results: a NULL text has no words, and an item without words is never found; items of
fewer than five words are found where all of their words stand in a row; repeated rows are judged alike; with an empty benchmark nothing is
found. Rows are told apart by doc_id and text, so that a NULL or repeated doc_id is no
problem.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep


@dataclass(frozen=True)
class Settings:
    """masks: of which every pattern of an item of 9 to 57 words that is acceptable under `penalty`,
    `least_score` and `short_share` has one as a hit; a test enumerates them. Shorter items have
    masks of their own (`short_mask`), which cost nothing where there are no such items.

    filter_words: 64-bit words of the filter, at least and at most; in between, four seeds get one.
    """

    masks: tuple[str, ...] = ("11011011", "1110111", "11110000101")
    penalty: int = 2
    least_score: int = 10
    short_share: float = 0.7
    filter_words: tuple[int, int] = (1 << 14, 1 << 17)


SHORT = 9
# Items with fewer words must stand in a document as a whole.
WHOLE = 5


def short_mask(n: int) -> str:
    """For items of `n` words, below `SHORT`: so many matches in a row as an acceptable pattern has at least."""
    return "1" * (n if n < WHOLE else 4 if n == 5 else 5)


def words(text: Column) -> Column:
    """Lower-cased words without anything but letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _seeds(hashes: Column, number: int, mask: str) -> Column:
    """array<struct<pos, h>> of the seeds of one mask; empty for a text shorter than the mask."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    starts = F.when(F.size(hashes) >= len(mask), F.sequence(F.lit(0), F.size(hashes) - len(mask))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *(F.get(hashes, i + o) for o in ones)).alias("h")),
    )


def _all_seeds(hashes: Column, masks: tuple[str, ...]) -> Column:
    # A mask has the same number wherever it is used, so that the hashes of documents and items agree.
    return F.concat(*(_seeds(hashes, int("1" + mask, 2), mask) for mask in masks))


def _item_seeds(hashes: Column, settings: Settings, lengths: list[int]) -> Column:
    """All seeds of an item: those of the masks, and for a short one those of its own mask."""
    seeds = _all_seeds(hashes, settings.masks)
    for n in lengths:
        seeds = F.when(F.size(hashes) == n, _all_seeds(hashes, (*settings.masks, short_mask(n)))).otherwise(seeds)
    return seeds


def _hashed(df: DataFrame, id_column: str, key: str) -> DataFrame:
    """The id, a key of id and text, and the hash of each word."""
    id_ = F.col(id_column).cast("long")
    return df.select(
        id_.alias(id_column),
        F.xxhash64(id_, F.col("text").cast("string")).alias(key),
        words(F.col("text")).alias("words"),
    ).select(id_column, key, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _slot(h: Column, size: int) -> tuple[Column, Column]:
    """Which word of the filter a hash belongs to, and which bit."""
    return F.pmod(F.shiftright(h, 6), F.lit(size)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def _filter(seeds: DataFrame, size: int) -> Column:
    """An array literal of `size` words whose bits say which hashes may occur.

    The words, not the seeds, come to the driver: always `size` of them.
    """
    word, bit = _slot(F.col("h"), size)
    masks = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    filled = seeds.select(word.alias("word"), F.get(masks, bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = [0] * size
    for row in filled.collect():
        bits[row.word] = row.bits
    # Folded to one literal when the query is planned.
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def overlaps(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row (doc_id, doc_key, item_id, score, words) for each document and item that it holds."""
    items = keep(_hashed(benchmark, "item_id", "item_key").distinct(), "benchmark-words")
    # Which of the few short lengths there are.
    short = items.where(F.size("hashes").between(1, SHORT - 1)).select(F.size("hashes").alias("n")).distinct()
    lengths = sorted(row.n for row in short.collect())
    masks = (*settings.masks, *sorted({short_mask(n) for n in lengths}))
    seeds = keep(
        items.select("item_key", F.explode(_item_seeds(F.col("hashes"), settings, lengths)).alias("x"))
        .select("item_key", F.col("x.pos").alias("item_pos"), F.col("x.h").alias("h"))
        .distinct(),
        "benchmark-seeds",
    )
    least, most = settings.filter_words
    size = min(most, max(least, 1 << (seeds.count() // 4).bit_length()))
    bits = _filter(seeds, size)
    one = F.lit(1).cast("long")

    def may_occur(x: Column) -> Column:
        word, bit = _slot(x["h"], size)
        return F.call_function("shiftrightunsigned", F.get(bits, word), bit).bitwiseAND(one) == one

    hashed = _hashed(docs, "doc_id", "doc_key")
    hits = (
        hashed.select("doc_id", "doc_key", F.filter(_all_seeds(F.col("hashes"), masks), may_occur).alias("hits"))
        # The outer form, as the plain one would compute the array once more to see whether it is empty.
        .select("doc_id", "doc_key", F.explode_outer("hits").alias("x"))
        .where("x IS NOT NULL")
        .select("doc_id", "doc_key", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"))
    )
    diagonals = keep(
        hits.join(seeds, "h").select("doc_id", "doc_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(),
        "seed-hits",
    )
    own, other = F.col("hashes"), F.col("item_hashes")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, i: Column) -> Column:
        equal = F.coalesce(F.get(own, i + F.col("shift")) == F.get(other, i), F.lit(False))
        now = F.greatest(F.lit(0), state["now"] + F.when(equal, 1).otherwise(-settings.penalty))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    score = F.aggregate(F.sequence(F.lit(0), F.size(other) - 1), start, step)["best"]
    needed = F.when(F.size(other) < WHOLE, F.size(other).cast("double")).otherwise(
        F.least(F.lit(float(settings.least_score)), settings.short_share * F.size(other))
    )
    wanted = diagonals.select(F.col("doc_key").alias("key")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Only texts with a hit are cut into words again.
    hit = docs.select("doc_id", "text").join(wanted, key == F.col("key"), "left_semi")
    texts = _hashed(hit, "doc_id", "doc_key").select("doc_key", "hashes").dropDuplicates(["doc_key"])
    return (
        diagonals.join(items.select("item_id", "item_key", F.col("hashes").alias("item_hashes")), "item_key")
        .join(texts, "doc_key")
        .select("doc_id", "doc_key", "item_id", F.size(other).alias("words"), score.alias("score"), needed.alias("needed"))
        .where("score >= needed")
        .groupBy("doc_id", "doc_key", "item_id")
        .agg(F.max("score").alias("score"), F.max("words").alias("words"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` without the documents that hold an item."""
    held = keep(overlaps(docs, benchmark, settings).select(F.col("doc_key").alias("held_key")).distinct(), "contaminated")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(held, key == F.col("held_key"), "left_anti")
