"""Elements of JSON arrays in files of any size, whose blocks are read one by one, in any task.

A block may begin anywhere: within a string, behind a backslash, in a comment, at any depth. Its
effect on what comes behind it is a small table, from each state at its start to the state and the
change of depth at its end. The tables are composed from block to block in the order of the
file, which gives each block its true start; then each is cut into elements, and what is left
at its ends is joined with the ends of its neighbours.

Spark's text reader deals out the blocks, with the closing brace as the end of a "line": only what
stands between two braces must fit into one value, never the array. One row per block reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import scratch, ship_package, stored
from .files import Listing, block_pieces, list_matching

# States of the reader outside and inside of strings and comments.
PLAIN, STRING, ESCAPE, SLASH, LINE, BLOCK, STAR = STATES = range(7)

_PLAIN = re.compile(r'"|/[/*]?|[{}\[\],]')
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.S)
_LINE_END = re.compile(r"[\r\n]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\r\n]*", re.S)
# What an unfinished comment began with, for text that begins within it.
_BEGUN = {LINE: "//", BLOCK: "/*", STAR: "/* *"}

# Tasks that blocks are dealt to: so many for each core, and more where one would get more than so many bytes.
_TASKS_PER_CORE, _BYTES_PER_TASK = 4, 128 << 20


def walk(text: str, state: int, marks: list[tuple[int, str]] | None = None) -> tuple[int, int]:
    """The state and the change of depth at the end of `text`; brackets and commas outside strings go to `marks`."""
    at, end, depth = 0, len(text), 0
    while at < end:
        if state == PLAIN:
            m = _PLAIN.search(text, at)
            if m is None:
                break
            found, at = m[0], m.end()
            if found == '"':
                state = STRING
            elif found == "//":
                state = LINE
            elif found == "/*":
                state = BLOCK
            elif found == "/":
                state = SLASH if at == end else PLAIN
            else:
                depth += (found in "{[") - (found in "}]")
                if marks is not None:
                    marks.append((m.start(), found))
        elif state == STRING:
            at = _STRING.match(text, at).end()
            if at < end:
                state = PLAIN if text[at] == '"' else ESCAPE
                at += 1
        elif state == ESCAPE:
            state, at = STRING, at + 1
        elif state == SLASH:
            state = {"/": LINE, "*": BLOCK}.get(text[at], PLAIN)
            at += state != PLAIN
        elif state == LINE:
            m = _LINE_END.search(text, at)
            if m is None:
                break
            state, at = PLAIN, m.end()
        elif state == STAR and text[at] == "/":
            state, at = PLAIN, at + 1
        else:
            close = text.find("*/", at)
            if close < 0:
                state = STAR if text[-1] == "*" else BLOCK
                break
            state, at = PLAIN, close + 2
    return state, depth


def blank(text: str, state: int = PLAIN) -> bool:
    """Whether there is nothing but white space and comments in `text`, which begins in `state`."""
    begun = _BEGUN.get(state, "/" if state == SLASH and text else "")
    return not _COMMENT.sub(" ", begun + text).strip()


def block_table(texts: Iterator[str]) -> list[tuple[int, int]]:
    """For each state at the start of a block, the state and the change of depth at its end."""
    now = [(state, 0) for state in STATES]
    for text in texts:
        known = {state: walk(text, state) for state in {state for state, _ in now}}
        now = [(known[state][0], depth + known[state][1]) for state, depth in now]
    return now


class Cutter:
    """Cuts one block, given in pieces, into elements and the fragments at its ends."""

    def __init__(self, name: str, state: int, depth: int):
        self.name, self.state, self.depth = name, state, depth
        self.begun: list[str] = []  # text of the element that is open
        self.complete: list[str] = []
        self.head: str | None = None  # the end of an element of an earlier block
        self.own = depth == 0  # whether the open element has begun in this block
        self.closed = 0

    def _fail(self) -> None:
        raise ValueError(f"not a JSON array: {self.name}")

    def _ends(self, text: str) -> None:
        whole, self.begun = "".join([*self.begun, text]), []
        if self.own:
            self.complete.append(whole)
        else:
            self.head, self.own = whole, True

    def add(self, text: str) -> None:
        marks: list[tuple[int, str]] = []
        first, at = self.state, 0
        self.state, _ = walk(text, first, marks)
        for place, mark in marks:
            if self.depth <= 0:
                # The brace at the very end of a file is the reader's own.
                if mark == "}" and self.depth == 0:
                    self.depth = -1
                elif mark != "[" or self.depth < 0:
                    self._fail()
                if not blank(text[at:place], first if at == 0 else PLAIN):
                    self._fail()
                at = place + 1
                self.depth += mark == "["
            elif self.depth == 1 and mark in ",]":
                self._ends(text[at:place])
                at = place + 1
                if mark == "]":
                    self.depth, self.closed = 0, self.closed + 1
            elif self.depth == 1 and mark == "}":
                self._fail()
            else:
                self.depth += (mark in "{[") - (mark in "}]")
        if self.depth > 0:
            self.begun.append(text[at:])
        elif self.depth == 0:
            # A slash at the very end may begin a comment: it is judged with what follows.
            rest = text[at:-1] if self.state == SLASH else text[at:]
            if not blank(rest, first if at == 0 else PLAIN):
                self._fail()

    def rows(self) -> Iterator[tuple[int, int, str | None]]:
        """(kind, place, text): 0 an element, 1 the end, 2 the beginning, 3 the middle of one, 4 the end of the array."""
        for place, text in enumerate(self.complete):
            yield 0, place, text
        if self.head is not None:
            yield 1, -1, self.head
        if self.depth > 0:
            yield (2 if self.own else 3), len(self.complete), "".join(self.begun)
        for _ in range(self.closed):
            yield 4, 0, None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Name and start of each block of a task, with its text in pieces."""

    def runs() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file_path", "block_start", "value")))
            for key, some in groupby(rows, key=lambda row: row[:2]):
                yield key, "".join(f"{value}}}" for *_, value in some)

    for (name, start), found in groupby(runs(), key=lambda run: run[0]):
        yield name, start, (text for _, text in found)


def array_elements(spark: SparkSession, root: str, pattern: str, listing: Listing | None = None) -> DataFrame:
    """(file_path, block_start, position, element) of the arrays in the matching files, as texts.

    `block_start` and `position` give the order in a file. A file that is no array is an error.
    """
    ship_package(spark)
    listing = listing or list_matching(spark, root, pattern)
    pieces = block_pieces(spark, root, pattern, listing=listing)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(_TASKS_PER_CORE * cores, listing.bytes // _BYTES_PER_TASK)
    # The same blocks for both passes, whatever the executors do meanwhile. Small ones share a task.
    fixed = {"spark.sql.files.minPartitionNum": cores, "spark.sql.files.maxPartitionNum": tasks}
    before = {key: spark.conf.get(key, None) for key in fixed}
    for key, number in fixed.items():
        spark.conf.set(key, before[key] or str(number))
    try:
        return _elements(spark, pieces)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def _elements(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, texts in _blocks(batches):
            found = block_table(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([start], pa.int64()), pa.array([[s for s, _ in found]]), pa.array([[d for _, d in found]])],
                ["file_path", "block_start", "states", "depths"],
            )

    found = pieces.mapInArrow(tables, "file_path string, block_start long, states array<long>, depths array<long>").collect()
    starts: dict[tuple[str, int], tuple[int, int]] = {}
    names = set()
    for name, blocks in groupby(sorted(found, key=lambda r: (r.file_path, r.block_start)), key=lambda r: r.file_path):
        state, depth = PLAIN, 0
        for block in blocks:
            starts[name, block.block_start] = state, depth
            state, depth = block.states[state], depth + block.depths[state]
        names.add(name)
    known = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, texts in _blocks(batches):
            cutter = Cutter(name, *known.value[name, start])
            for text in texts:
                cutter.add(text)
            rows = list(cutter.rows())
            kinds, places, elements = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.string()),
                    pa.array([start] * len(rows), pa.int64()),
                    pa.array(kinds, pa.int32()),
                    pa.array(places, pa.int64()),
                    pa.array(elements, pa.string()),
                ],
                ["file_path", "block_start", "kind", "position", "element"],
            )

    schema = "file_path string, block_start long, kind int, position long, element string"
    parts = stored(pieces.mapInArrow(cut, schema), scratch(spark, "array-parts"))
    ends = {r.file_path: r.n for r in parts.where("kind = 4").groupBy("file_path").agg(F.count("*").alias("n")).collect()}
    wrong = sorted(name for name in names if ends.get(name) != 1)
    if wrong:
        raise ValueError(f"not a JSON array: {wrong[0]}")

    # At most two fragments a block: an element belongs to the block that it begins in.
    order = Window.partitionBy("file_path").orderBy("block_start", "kind")
    begins = F.when(F.col("kind") == 2, F.struct("block_start", "position"))
    fragments = parts.where(F.col("kind").between(1, 3)).withColumn("of", F.last(begins, ignorenulls=True).over(order))
    whole = fragments.groupBy("file_path", "of").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", "kind", "element"))), lambda x: x["element"]), "").alias("element")
    )
    stitched = whole.select("file_path", "of.block_start", "of.position", "element")
    elements = parts.where("kind = 0").select("file_path", "block_start", "position", "element").unionByName(stitched)
    # Nothing stands between the brackets of an empty array.
    nothing = F.regexp_replace("element", r"(?s)/\*.*?\*/|//[^\r\n]*", "").rlike(r"^\s*$")
    return elements.where(~nothing)
