"""Token ids in files of independent zstandard frames with a trailing seek table.

File format. One zstandard frame per document with its ids as little-endian unsigned
integers (16 bits where the vocabulary allows, else 32), then a skippable frame (magic
0x184D2A50) with the documents: width of an id, then doc_id and number of ids of each
frame; then the seek table, a skippable frame (magic 0x184D2A5E) with compressed size,
decompressed size and checksum (low 32 bits of XXH64 of the decompressed bytes) of
every frame before it, the number of entries, a descriptor byte (128: checksums) and
the magic 0x8F92EAB1. Any zstandard decoder reads the file as one stream; a reader that
knows the table decompresses single documents only.

Documents are dealt by ranges of doc_id, so that files follow each other; ties go by
text. A NULL doc_id is first. A NULL text is empty: its frame holds the end id alone.
Repeated rows have frames of their own.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_stream import PATTERN, byte_letters
from .common import keep, texts
from .shared_files import new_file, open_file

_DOCUMENTS = 0x184D2A50
_SEEK_TABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_CHECKSUMS = 0x80
LEVEL = 3
# Words whose ids a worker remembers in each of two generations, and the longest one it does so for.
MEMO_ENTRIES = 1 << 18
MEMO_CHARS = 48
# New words cut into pre-tokens at once.
CHUNK = 8_192
# A space between two other characters that are no white space: no pre-token goes on across it.
BORDER = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\s(?: |(?<= )\s)")  # a space next to other white space
MANIFEST = "file string, first_id long, documents long, tokens long"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as bytes, by the library; words are remembered, and so are the pre-tokens of new words.

    A byte-level pre-token has a space at its beginning only, so that a single space between two
    words is always a border, and the ids of a word with the space before it are the same in any
    text. The tokens that begin with a space tell where the next word of a joined text begins.
    What is not between such borders (the first word, words next to further white space) is
    encoded on its own, and so are whole texts where the vocabulary is of another kind.

    `known` has words without their space; a key with a space in front is that string without it.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.by_words = self._by_words()
        self.starts = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.pattern = regex.compile(PATTERN)
        self.letters = "".join(sorted(byte_letters(), key=byte_letters().get))
        self.tokenize = self.library.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _by_words(self) -> bool:
        from tokenizers import models, pre_tokenizers

        cut, model = self.library.pre_tokenizer, self.library.model
        return (
            isinstance(cut, pre_tokenizers.ByteLevel)
            and cut.use_regex
            and not cut.add_prefix_space
            and isinstance(model, models.BPE)
            and not model.dropout
            and self.library.normalizer is None
            and not any(" " in x for x in self.added)
        )

    def _bytes(self, given: list[str]) -> list[bytes]:
        return [
            np.array(x.ids, dtype=self.type).tobytes()
            for x in self.library.encode_batch_fast(given, add_special_tokens=False)
        ]

    def _word_bytes(self, words: list[str]) -> Iterable[bytes]:
        """Of each word, the bytes of its ids behind a space; the library's model gets each new pre-token."""
        tokens = self.pattern.findall(" " + " ".join(words))
        if len(self.pieces) > MEMO_ENTRIES:
            self.pieces.clear()
        new = list(set(tokens).difference(self.pieces))
        ids: list[int] = []
        ends = [0]
        for token in new:
            shown, _ = codecs.charmap_decode(token.encode(), "strict", self.letters)
            ids += [x.id for x in self.tokenize(shown)]
            ends.append(len(ids))
        self.pieces.update(zip(new, self._slices(np.array(ids, dtype=self.type), np.array(ends))))
        data = b"".join(map(self.pieces.__getitem__, tokens))
        for token in new:
            if len(token) > MEMO_CHARS:
                del self.pieces[token]
        ids = np.frombuffer(data, dtype=self.type)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(words):
            raise ValueError(f"{len(words)} words have {len(at)} tokens with a space")
        return self._slices(ids, np.append(at, len(ids)))

    @staticmethod
    def _slices(ids: np.ndarray, borders: np.ndarray) -> Iterable[bytes]:
        data, at = ids.tobytes(), (borders * ids.itemsize).tolist()
        return map(data.__getitem__, map(slice, at, at[1:]))

    def _cut(self, text: str, words: dict[str, None], alone: dict[str, None]) -> list[str]:
        """Keys of the text's parts; those not known are added to `words` or, with a space in front, `alone`."""
        if not self.by_words or any(x in text for x in self.added):
            parts = [" " + text]
            alone[parts[0]] = None
            return parts
        parts = text.split(" ")
        first = " " + parts[0]
        new = set(filterfalse(self.known.__contains__, parts)).difference(words)
        if new and ODD.search(f" {' '.join(new)} "):
            parts = BORDER.split(text)
            first = " " + parts[0]
            parts = [f"  {x}" if " " in x or x[-1].isspace() else x for x in parts[1:]]
            for part in filterfalse(self.known.__contains__, parts):
                (alone if part[0] == " " else words)[part] = None
            parts.insert(0, first)
        else:
            words.update(dict.fromkeys(new))
            parts[0] = first
        if first not in self.known:
            alone[first] = None
        return parts

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        if len(self.known) > MEMO_ENTRIES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        words: dict[str, None] = {}
        alone: dict[str, None] = {}
        cut = [self._cut(text, words, alone) for text in batch]
        for new in (words, alone):
            for key in new.keys() & older.keys():  # short ones only
                known[key] = older[key]
                del new[key]
        given = list(words)
        try:
            for at in range(0, len(given), CHUNK):
                part = given[at : at + CHUNK]
                known.update(zip(part, self._word_bytes(part)))
            known.update(zip(alone, self._bytes([key[1:] for key in alone])))
            for parts in cut:
                yield b"".join(map(known.__getitem__, parts))
        finally:  # a reader may stop at the last text
            for key in (*words, *alone):
                if len(key) > MEMO_CHARS:
                    known.pop(key, None)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, with what it remembers."""
    return Encoder(path)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Writer:
    """Writes one file; holds 24 bytes a document until the end."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.ids: list[tuple[int, int]] = []
        self.entries: list[bytes] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.ids.append((doc_id, len(data) // self.width))

    def close(self) -> None:
        documents = struct.pack("<B", self.width) + b"".join(struct.pack("<qq", *x) for x in self.ids)
        self.out.write(_skippable(_DOCUMENTS, documents))
        # The table also lists the frame with the documents; it decompresses to nothing.
        entries = [*self.entries, struct.pack("<III", len(documents) + 8, 0, 0)]
        footer = struct.pack("<IBI", len(entries), _CHECKSUMS, _SEEKABLE)
        self.out.write(_skippable(_SEEK_TABLE, b"".join(entries) + footer))


class Reader:
    """Reads single documents of one file by its seek table."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = 12 * count + 9
        file.seek(size - length - 8)
        if struct.unpack("<II", file.read(8)) != (_SEEK_TABLE, length):
            raise ValueError("the seek table does not have its frame")
        table = np.frombuffer(file.read(12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        file.seek(int(ends[-1] - table[-1, 0]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != _DOCUMENTS or length + 8 != table[-1, 0] or ends[-1] + 12 * count + 17 != size:
            raise ValueError("the list of documents is not where the seek table has it")
        self.type = np.dtype(f"<u{file.read(1)[0]}")
        self.ids = np.frombuffer(file.read(length - 1), dtype="<i8").reshape(-1, 2)
        self.table, self.starts = table[:-1], ends[:-1] - table[:-1, 0]
        if len(self.ids) != len(self.table):
            raise ValueError("frames and documents differ in number")
        self.decompressor = zstandard.ZstdDecompressor()

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document; raises if its checksum or length is wrong."""
        self.file.seek(int(self.starts[i]))
        size, raw, checksum = map(int, self.table[i])
        data = self.decompressor.decompress(self.file.read(size), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} does not match its entry in the seek table")
        ids = np.frombuffer(data, dtype=self.type)
        if len(ids) != self.ids[i, 1]:
            raise ValueError(f"frame {i} has {len(ids)} ids, {self.ids[i, 1]} are listed")
        return ids


_NO_ID = -(1 << 63)  # stands for a NULL doc_id in files


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Encode every document, append `end_id`, write the files; one row per file, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, tokens = None, None, 0
        end = b""
        with new_file(folder, ".ids.zst") as (out, name):
            for batch in batches:
                if writer is None:
                    encoder = _encoder(path)
                    writer, end = Writer(out, encoder.type.itemsize), np.array([end_id], encoder.type).tobytes()
                ids = batch.column("doc_id").to_pylist()
                for doc_id, data in zip(ids, encoder.encode(batch.column("text").to_pylist())):
                    writer.add(_NO_ID if doc_id is None else doc_id, data + end)
            if writer is None:
                writer = Writer(out, 2)
            tokens = sum(n for _, n in writer.ids)
            writer.close()
        if writer.ids:
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "first_id": writer.ids[0][0], "documents": len(writer.ids), "tokens": tokens}],
                schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())]),
            )

    # Of equal ids, equal texts stay together, so that a repeated id does not bind all its rows to one task.
    key = F.xxhash64("text")
    dealt = texts(docs).withColumn("key", key)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key").drop("key")
    return keep(dealt.mapInArrow(run, MANIFEST), "token-files")


def read(files: DataFrame, folder: str, wanted: Iterable[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids_crc32, ids) of the listed files; only `wanted` ones if given.

    `start` is the number of ids before the document in all files. The list of files
    (a row for each) passes through the driver to add up their sizes. Every document is
    read and checked; without `with_ids` its ids are not handed on.
    """
    spark = files.sparkSession
    rows = sorted(files.collect(), key=lambda r: (r.first_id, r.file))
    offsets, total = [], 0
    for r in rows:
        offsets.append((r.file, total))
        total += r.tokens
    only = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with open_file(folder, name) as file:
                    reader = Reader(file)
                    starts = start + np.cumsum(reader.ids[:, 1]) - reader.ids[:, 1]
                    chosen = [i for i in range(len(reader.ids)) if only is None or int(reader.ids[i, 0]) in only]
                    for at in range(0, len(chosen), 256):
                        part = chosen[at : at + 256]
                        found = [reader.read(i) for i in part]
                        listed = [int(reader.ids[i, 0]) for i in part]
                        columns = {
                            "doc_id": pa.array([None if x == _NO_ID else x for x in listed], pa.int64()),
                            "start": pa.array([int(starts[i]) for i in part], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)

    listed = spark.createDataFrame(offsets, "file string, start long").repartition(max(1, len(offsets)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return listed.mapInArrow(run, schema + ", ids array<int>" if with_ids else schema)
