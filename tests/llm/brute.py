"""Plain Python versions of the dealt operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(_LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def links(rows: list[tuple[int | None, str | None]]) -> set[tuple[int, int]]:
    """Pairs of row numbers that are linked, each pair that shares a shingle being tried."""
    sets = [shingles(text) for _, text in rows]
    holders = defaultdict(list)
    for i, one in enumerate(sets):
        for s in one:
            holders[s].append(i)
    shared: Counter = Counter()
    for i, one in enumerate(sets):
        for j, n in Counter(j for s in one for j in holders[s] if j > i).items():
            shared[i, j] = n
    return {
        (i, j) for (i, j), n in shared.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)
    }


def components(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int | None]]:
    """(doc_id, n_shingles, component_id) of each row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links(rows):
        parent[root(j)] = root(i)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(shingles(text)), least.get(root(i))) for i, (doc_id, text) in enumerate(rows)]


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base spans."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secret_row(text: str | None) -> tuple[int, int, int, str]:
    spans = secrets(text)
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
    counts = Counter(kind for _, _, kind, _ in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest()


def piece_counts(text: str | None) -> tuple[int, int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return len((text or "").encode()), len(model.encode(text or ""))


@lru_cache(maxsize=1)
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def archive_rows(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int]]:
    tokenizer, out, at = byte_tokenizer(), [], 0
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def round_trip(text: str | None) -> tuple[int, str, str]:
    tokenizer = byte_tokenizer()
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def warc_rows(rows: list[tuple[int, str | None]]) -> list[tuple]:
    largest: dict[bytes, int] = {}
    for page_id, html in rows:
        payload = (html or "").encode()
        largest[payload] = max(largest.get(payload, page_id), page_id)
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        first = largest[payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = page_id != first
        out.append((page_id, len(payload), digest, "revisit" if again else "response", first if again else None))
    return out


def measures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {i + k for starts in where.values() if len(starts) > 1 for i in starts for k in range(8)}
    n, repeated = len(words), len(covered)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def _item_words(text: str | None) -> list[str]:
    kept = re.sub(r"[^\w\x20\x09-\x0D]+|_", "", (text or "").lower())
    return [w for w in re.split(r"[\x20\x09-\x0D]+", kept) if w]


def holds_an_item(text: str | None, items: list[str | None]) -> bool:
    """Whether the best segment along some offset is good enough; with the k-th match at place a, 3k - 2a is its score up to there."""
    where = defaultdict(list)
    for place, word in enumerate(_item_words(text)):
        where[word].append(place)
    for item in items:
        words = _item_words(item)
        needed = len(words) if len(words) < 5 else min(10, 0.7 * len(words))
        offsets = defaultdict(list)
        for place, word in enumerate(words):
            for own in where.get(word, ()):
                offsets[own - place].append(place)
        for places in offsets.values():
            sums = [3 * k - 2 * a for k, a in enumerate(places)]
            low, best = sums[0], 0
            for value in sums:
                low = min(low, value)
                best = max(best, value - low + 1)
            if best >= needed:
                return True
    return False


def marked(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """`text` with its spans, in order, replaced by marks; those that overlap by one."""
    out, at = [], 0
    for start, _, _, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
