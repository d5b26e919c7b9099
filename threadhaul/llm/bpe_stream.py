"""Byte-level BPE as a streaming transducer, and its decoding.

Encoding. A text is cut into pre-tokens by the vocabulary's fixed pattern, and merges
stay inside a pre-token. Whether a token is final depends on bytes behind it only
through chains of merges: a merge (u, v) may be prevented by an earlier merge whose
left part is a right-hand constituent of v, that one by a still earlier merge, and so
on. The longest such chain, in bytes, is the merge list's sufficient lookahead. It is
computed once from the list. A long pre-token is then read through a window: of the
merged window, tokens that end at least the lookahead before its end are stable and
are emitted; the next window begins where they end (the tokens of a suffix that
begins at a token border are those of the whole). Besides the text itself, memory
depends on the lookahead and on CHUNK, never on the pre-token: longer ones are read from
the text in blocks, and their ids are handed on block by block.

Decoding. Bytes of one id after the other go through a UTF-8 state machine that keeps
at most three bytes of an unfinished character; ill-formed sequences become U+FFFD,
one for each longest valid beginning.

Defined results: a NULL text is empty and has no ids; repeated rows are encoded each.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, groupby, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

# Fixed pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pre-tokens whose ids a worker remembers in each of two generations, and the longest one it does so for.
MEMO_ENTRIES = 1 << 17
MEMO_BYTES = 64
# Pre-tokens handed on at once.
CHUNK = 8_192


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, all others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges by rank, bytes by id, and the sufficient lookahead."""

    def __init__(self, spec: dict):
        kind, before = spec["model"], spec.get("pre_tokenizer") or {}
        if kind["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without prefix space and normaliser is needed")
        letters = byte_letters()
        ids: dict[str, int] = kind["vocab"]
        self.bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) for token, i in ids.items() if all(c in letters for c in token)
        }
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(kind["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[left + right]
            self.merges.setdefault((ids[left], ids[right]), (rank, made))
            self.parts.setdefault(made, (ids[left], ids[right]))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = {rank: made for rank, made in self.merges.values()}
        self.lookahead = self._lookahead()
        self.longest = max(map(len, self.bytes.values()))

    def _spine(self, token: int) -> Iterator[int]:
        """A token and its right-hand constituents down to its last byte."""
        yield token
        while token in self.parts:
            token = self.parts[token][1]
            yield token

    def _lookahead(self) -> int:
        reach: dict[int, int] = {}  # by left part: bytes behind it that its merges so far may depend on
        for (left, right), _ in sorted(self.merges.items(), key=lambda x: x[1]):
            behind = max(reach.get(x, 0) for x in self._spine(right))
            reach[left] = max(reach.get(left, 0), len(self.bytes[right]) + behind)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a piece: the lowest rank first, of equal ones the leftmost."""
        return self._merge_short(data) if len(data) <= MEMO_BYTES else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        """Looks for the lowest rank anew after each merge."""
        single, rank_of, made, none = self.single, self.ranks.get, self.made, 1 << 60
        token = [single[b] for b in data]
        ranks = [rank_of(pair, none) for pair in zip(token, token[1:])]
        while ranks and (lowest := min(ranks)) < none:
            i = ranks.index(lowest)
            token[i] = made[lowest]
            del token[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((token[i], token[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((token[i - 1], token[i]), none)
        return token

    def _merge_long(self, data: bytes) -> list[int]:
        """Keeps the possible merges in a heap."""
        token = [self.single[b] for b in data]
        after = [*range(1, len(token)), -1]
        before = list(range(-1, len(token) - 1))
        merges = self.merges
        heap = []
        for i in range(len(token) - 1):
            if found := merges.get((token[i], token[i + 1])):
                heap.append((found[0], i, token[i], token[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or token[i] != left or token[j] != right:
                continue
            token[i], token[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if found := merges.get((made, token[after[j]])):
                    heapq.heappush(heap, (found[0], i, made, token[after[j]], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((token[h], made))):
                heapq.heappush(heap, (found[0], h, token[h], made, found[1]))
        return [t for t in token if t >= 0]

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one pre-token that comes in blocks, emitted as soon as they are stable."""
        window = b""
        least = 2 * (self.lookahead + self.longest)
        for block in blocks:
            window += block
            if len(window) < least:
                continue
            stable, end, out = len(window) - self.lookahead, 0, []
            for token in self.merge(window):
                size = len(self.bytes[token])
                if end + size > stable:
                    break
                end += size
                out.append(token)
            window = window[end:]
            yield out
        yield self.merge(window)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        words = Vocabulary(json.load(file))
    gc.freeze()  # its many small objects stay; the collector need not look at them again
    return words


class _Memo(dict):
    """Ids and decimal text of short pre-tokens, of bounded size.

    A full generation becomes the old one; what is asked for again moves to the new one.
    """

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words = words
        self.old: dict[str, tuple[Sequence[int], str]] = {}

    def __missing__(self, token: str) -> tuple[Sequence[int], str]:
        made = self.old.get(token)
        if made is None:
            data = token.encode()
            if len(data) > MEMO_BYTES:
                step = self.words.lookahead + self.words.longest
                blocks = (data[i : i + step] for i in range(0, len(data), step))
                ids = list(chain.from_iterable(self.words.transduce(blocks)))
                return ids, ",".join(map(str, ids))
            ids = self.words.merge(data)
            made = (tuple(ids), ",".join(map(str, ids)))
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[token] = made
        return made


@lru_cache(maxsize=1)
def _memo(path: str) -> _Memo:
    """One for all tasks of a worker."""
    return _Memo(vocabulary(path))


class Transducer:
    """Encodes texts and decodes ids, chunk by chunk."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.memo = _memo(path)
        self.pattern = regex.compile(PATTERN)
        special = self.words.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.by_id = [self.words.bytes.get(i, b"") for i in range(max(self.words.bytes) + 1)]

    def chunks(self, text: str) -> Iterator[list[tuple[Sequence[int], str]]]:
        """The (ids, decimal text) of the pre-tokens of a text, in chunks."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for part in parts:
            if part in self.words.special:
                i = self.words.special[part]
                yield [([i], str(i))]
            elif len(part) <= CHUNK:
                if found := [self.memo[x] for x in self.pattern.findall(part)]:
                    yield found
            else:
                matches = self.pattern.finditer(part)
                while some := list(islice(matches, CHUNK)):
                    for long, group in groupby(some, lambda m: m.end() - m.start() > CHUNK):
                        if long:
                            yield from (found for m in group for found in self._blocks(part, *m.span()))
                        else:
                            yield [self.memo[m.group()] for m in group]

    def _blocks(self, text: str, start: int, end: int) -> Iterator[list[tuple[Sequence[int], str]]]:
        """The ids of one long pre-token, as they become stable."""
        step = self.words.lookahead + self.words.longest
        blocks = (text[i : min(i + step, end)].encode() for i in range(start, end, step))
        for ids in self.words.transduce(blocks):
            if ids:
                yield [(ids, ",".join(map(str, ids)))]

    def encode(self, text: str) -> list[int]:
        return [i for found in self.chunks(text) for ids, _ in found for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        out = [machine.decode(self.by_id[i]) for i in ids]
        return "".join(out) + machine.decode(b"", final=True)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the comma-joined ids, SHA-256 of the decoded text."""
        numbers, decoded = hashlib.sha256(), hashlib.sha256()
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        n, get = 0, self.by_id.__getitem__
        for found in self.chunks(text):
            ids = list(chain.from_iterable(x[0] for x in found))
            numbers.update(("," if n else "").encode() + ",".join([x[1] for x in found]).encode())
            n += len(ids)
            decoded.update(machine.decode(b"".join(map(get, ids))).encode())
        decoded.update(machine.decode(b"", final=True).encode())
        return n, numbers.hexdigest(), decoded.hexdigest()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and `ids`, an array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                ids = [machine.encode(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and text; NULL ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in batches:
            found = [machine.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are encoded, then decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in batches:
            rows = [machine.digests(text) for text in batch.column("text").to_pylist()]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
