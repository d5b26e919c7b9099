"""Grouping of spelling variants: Gram matrices of letter counts, in blocks of like words.

Words are counted in all texts, once per document and word before the shuffle. Two words that
differ by one letter have letter counts whose squared distance is at most two, and these
distances come for a whole block of words from one matrix product, |a|^2 + |b|^2 - 2 ab. Pairs
within two are then compared letter by letter.

A block holds the words with equal numbers of letters in each of a few groups of letters, hence
of equal length. One edit takes a letter from one group and adds one to another, so that two near
words meet in a cell: the block with the letters they share. Every word goes to the cell of its
own block, and to those that lack one of its letters; in a cell, a word meets the others of the
block itself, those one letter longer, and two of the longer ones meet if they lack letters of
different groups. So every near pair meets in exactly one cell, and a word is sent to as many
cells as there are groups, and one more.

A cell with many words is cut into tiles by a hash of the word, every two of which meet in a task
of their own: no task holds more than two tiles. The work on one block still grows with the square
of its size, which is what matrix products cost; more groups of letters make smaller blocks.

Defined results: a NULL text has no words; repeated rows are counted each; a row without id spoils
words by a hash of `:<word>`; empty tables give no words. Of near words with equal numbers the
first in code-point order is the form. Only A-Z are lower-cased, as the fixed letters say.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
# Distinct words a task gathers before it hands them on.
_GATHER = 200_000
# A longer text is cut into runs one by one, so that they need not be held at once.
_LONG_TEXT = 1 << 20
# Elements of one matrix product, and bytes of one comparison of letters.
_PRODUCT = 4 << 20
_COMPARED = 8 << 20
# Up to this length all numbers of a product are exact in single precision.
_SINGLE = 2_000


@dataclass(frozen=True)
class Settings:
    """min_length, min_count: which words count. rise: how many times as frequent a form must be.

    spoil_every: of so many (document, word) pairs one loses a letter; 0 spoils none.
    """

    min_length: int = 6
    min_count: int = 5
    rise: int = 5
    spoil_every: int = 199
    groups: int = 6
    tile_words: int = 2_048
    tile_letters: int = 4 << 20


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def spoiled(word: str, start: int, every: int) -> str:
    """`word`, without one letter if its hash, begun at `start`, is a multiple of `every`."""
    if not every or (h := zlib.crc32(word.encode(), start)) % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id") -> DataFrame:
    """The words (word, n) of all texts that are long and frequent enough."""

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = _RUN.findall(text) if len(text) < _LONG_TEXT else (m[0] for m in _RUN.finditer(text))
                for run, n in Counter(runs).items():
                    if len(run) >= settings.min_length:
                        word = spoiled(lowered(run), start, settings.spoil_every)
                        if len(word) >= settings.min_length:
                            seen[word] += n
                if len(seen) > _GATHER:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    counts = plain.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= settings.min_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words in a row (each is one byte), and the length of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), lengths


def block_of(words: list[str], groups: int) -> np.ndarray:
    """Per word, its number of letters in each group of letters."""
    data, lengths = letters(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * groups + data % groups, minlength=len(words) * groups)
    return counts.reshape(len(words), groups).astype(np.int32)


def _cells(words: DataFrame, groups: int) -> DataFrame:
    """Every word in each of its cells; `lacks` is 0 in that of its own block, else 1 + the group of the letter."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            blocks = block_of(batch.column("word").to_pylist(), groups)
            rows, lacks, cells = [np.arange(len(batch))], [np.zeros(len(batch), np.int32)], [blocks]
            for g in range(groups):
                having = np.flatnonzero(blocks[:, g] > 0)
                fewer = blocks[having]
                fewer[:, g] -= 1
                rows.append(having), lacks.append(np.full(len(having), g + 1, np.int32)), cells.append(fewer)
            at = pa.array(np.concatenate(rows))
            keys = np.concatenate(cells).astype("<i4")
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * groups), len(keys), [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [key.cast(pa.binary()), pa.array(np.concatenate(lacks)), batch.column("word").take(at), batch.column("n").take(at)],
                ["cell", "lacks", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(sent, "cell binary, lacks int, word string, n long")


def _tiled(words: DataFrame, settings: Settings) -> DataFrame:
    """The words of each cell, in every pair of tiles (low, high) that its own tile belongs to."""
    cells = _cells(words, settings.groups)
    tiles = F.greatest(
        F.ceil(F.count("*") / settings.tile_words), F.ceil(F.sum(F.length("word")) / settings.tile_letters)
    ).cast("int")
    large = keep(cells.groupBy("cell").agg(tiles.alias("tiles")).where(F.col("tiles") > 1), "spelling-large-cells")
    tiled = cells.join(large, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.select(
        "cell", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "lacks", "word", "n"
    )


def _products(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[slice, slice]]:
    """Ranges of rows whose pairs may be near; `a`, `b`: what each word lacks, in ascending order.

    Words that lack a letter of the same group are in one block, and meet in its own cell.
    """
    if len(a) * len(b) <= 1 << 16:
        yield slice(0, len(a)), slice(0, len(b))
        return
    for value in np.unique(a):
        first, last = np.searchsorted(a, [value, value + 1])
        start, end = np.searchsorted(b, [value, value + 1])
        if value == 0:
            ranges = [(0, len(b))]
        else:
            ranges = [(end, len(b))] if same else [(0, start), (end, len(b))]
        for start, end in ranges:
            if end > start:
                step = max(1, _PRODUCT // (end - start))
                for at in range(first, last, step):
                    yield slice(at, min(at + step, last)), slice(start, end)


def _one_edit(codes: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by exactly one letter; `codes` has a word in each row, zeros behind it."""
    out = np.zeros(len(i), bool)
    step = max(1, _COMPARED // max(1, codes.shape[1]))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        swap = lengths[a] > lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        differs = codes[a] != codes[b]
        equal_length = lengths[a] == lengths[b]
        found = equal_length & (differs.sum(axis=1) == 1)
        longer = np.flatnonzero(lengths[b] == lengths[a] + 1)
        if len(longer):
            # With the first differing letter of the longer word gone, the rest must agree.
            first = differs[longer].argmax(axis=1)
            behind = np.arange(codes.shape[1] - 1) >= first[:, None]
            found[longer] = ~((codes[a[longer], :-1] != codes[b[longer], 1:]) & behind).any(axis=1)
        out[at : at + step] = found
    return out


def near_in_tiles(words: list[str], lacks: np.ndarray, tile: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs of one cell, once each, as row numbers; of two tiles only pairs between them."""
    data, lengths = letters(words)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    codes = np.zeros((len(words), int(lengths.max()) + 1), np.uint8)
    codes[owner, np.arange(len(data)) - starts[owner]] = data
    present, used = np.unique(data), np.zeros(256, np.int64)
    used[present] = np.arange(len(present))
    exact = np.float32 if lengths.max() <= _SINGLE else np.float64
    counts = np.bincount(owner * len(present) + used[data], minlength=len(words) * len(present))
    counts = counts.reshape(len(words), len(present)).astype(exact)
    squares = (counts * counts).sum(axis=1, keepdims=True)
    ones = np.ones_like(squares)
    left, right = np.hstack([-2 * counts, squares, ones]), np.hstack([counts, ones, squares]).T

    order = np.argsort(lacks, kind="stable")
    a = order[tile[order] == low]
    b = a if low == high else order[tile[order] == high]
    found_i, found_j = [], []
    for rows, columns in _products(lacks[a], lacks[b], low == high):
        within = np.flatnonzero(left[a[rows]] @ right[:, b[columns]] <= 2)
        width = columns.stop - columns.start
        at_i, at_j = within // width + rows.start, within % width + columns.start
        if low == high:
            at_i, at_j = at_i[once := at_i < at_j], at_j[once]
        i, j = a[at_i], b[at_j]
        meet = (lacks[i] == 0) | (lacks[i] != lacks[j])
        i, j = i[meet], j[meet]
        near = _one_edit(codes, lengths, i, j)
        found_i.append(i[near]), found_j.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every two near words, both ways: (word, near, near_n)."""
    tiled = _tiled(words, settings).repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high", "tile", "lacks", "word", "n")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), members in itertools.groupby(rows(batches), key=lambda row: row[:3]):
            _, _, _, tile, lacks, names, n = zip(*members)
            if len(names) < 2:
                continue
            i, j = near_in_tiles(list(names), np.array(lacks), np.array(tile), low, high)
            if len(i):
                both, back = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                name, number = pa.array(names, pa.string()), pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [name.take(both), name.take(back), number.take(back)], ["word", "near", "near_n"]
                )

    return tiled.mapInArrow(pairs, "word string, near string, near_n long")


def _roots(forms: DataFrame, most: int, settings: Settings) -> DataFrame:
    """The last form of each word that has one. A form is `rise` times as frequent, so that chains are short."""
    longest = max(1, math.floor(math.log(max(most / settings.min_count, 1), settings.rise)) + 1)
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = keep(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return roots


def spelling_groups(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id") -> DataFrame:
    """Per word: n, n_near, its form (the most frequent near word, if frequent enough), form_n, and its root."""
    words = keep(word_counts(docs, settings, id_column), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, settings).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    more = -F.col("best.less") >= settings.rise * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(more, F.col("best.near")).alias("form"),
        F.when(more, -F.col("best.less")).alias("form_n"),
    )
    forms = keep(forms, "spelling-forms")
    most = forms.agg(F.max("n")).first()[0] or 0
    grouped = forms.join(_roots(forms, most, settings), "word", "left")
    return grouped.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
