"""Words of a whole Arrow batch of texts at once, as numpy arrays over its bytes.

A word is a longest run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. No byte of a multi-byte UTF-8 character is one of
these, so that the bytes can be cut without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the hashes; any would do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Words:
    """The words of a batch: `starts` and `ends` in `data`, `first[i]:first[i+1]` those of row i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if pa.types.is_large_string(column.type):
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        else:
            column = column.cast(pa.string())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32).astype(np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        begin, end = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[begin:end] if raw is not None and end > begin else np.zeros(0, np.uint8)
        self.rows = offsets - begin if len(column) else np.zeros(1, np.int64)
        self.raw = data
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACES[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        borders = self.rows[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        opens[borders] |= inside[borders]
        closes[borders - 1] |= inside[borders - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.rows)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal bytes in any batch."""
        with np.errstate(over="ignore"):
            powers = np.full(len(self.data) + 1, _BASE, dtype=np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
            back = np.full(len(self.data) + 1, np.uint64(_inverse(int(_BASE))), dtype=np.uint64)
            back[0] = 1
            np.cumprod(back, out=back)
            values = (sums[self.ends] - sums[self.starts]) * back[self.starts]
            values ^= (self.ends - self.starts).astype(np.uint64) * _STEP
        return mixed(values)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` values in a row; shorter input has none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = mixed(total * _STEP + hashes[k : k + n])
    return total


# Bytes of text that are worked on at once; a longer single text is a part of its own.
PART_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the arrays over the bytes of their texts stay small."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + PART_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end
