"""WARC archives compressed with zstandard and a dictionary, written and read.

File format. A skippable frame (magic 0x184D2A5D) with the dictionary comes first, then
one frame per record. A record is a WARC/1.1 header block, an empty line, the payload
and two line ends. Of records with equal payloads, the one with the largest page_id is
a response; others are revisits without a body, which name the response.

The reader takes the dictionary from the leading frame, decodes frame by frame, and
checks version line, mandatory headers, record type, Content-Length and payload digest;
a frame that holds less or more than one record is an error.

Defined results: a NULL html is an empty payload; NULL urls give an empty target; of
rows with equal payload and equal (largest) page_id all are responses, since none is
smaller; rows without page_id revisit any row that has one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, keep
from .shared_files import new_file, open_file

_DICTIONARY = 0x184D2A5D
_FRAME = struct.pack("<I", zstandard.MAGIC_NUMBER)
LEVEL = 3
_READ = 1 << 18
_EMPTY_DATE = "1970-01-01T00:00:00Z"  # pages have no time of capture


@dataclass(frozen=True)
class Settings:
    """The dictionary is trained on at most `sample` rows of at most `sample_bytes` each."""

    sample: int = 400
    sample_bytes: int = 1 << 16
    dictionary_bytes: int = 1 << 15
    least_payload: int = 0


def digest(payload: bytes) -> str:
    """Upper-case base 32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(pages: DataFrame, settings: Settings = Settings()) -> bytes:
    """A dictionary from a bounded sample of pages; empty if there are too few."""
    fit = pages.select("page_id", F.col("html").cast("string").alias("html")).where(
        F.octet_length("html").between(1, settings.sample_bytes)
    )
    rows = first_by_hash(fit, settings.sample, "page_id", "html").orderBy("page_id", "html").collect()
    samples = [r.html.encode() for r in rows]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * settings.dictionary_bytes:
        return b""
    return zstandard.train_dictionary(settings.dictionary_bytes, samples).as_bytes()


def record(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", _EMPTY_DATE),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    body = payload if kind == "response" else b""
    headers.append(("Content-Length", str(len(body))))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return lines.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; raises where the record is not well formed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 header block")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    need = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length")
    if missing := [x for x in need if x not in headers]:
        raise ValueError(f"missing headers {missing}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{len(rest) - 4} bytes of content, {length} are declared")
    kind, body = headers["warc-type"], rest[:length]
    if kind not in ("response", "revisit") or (kind == "revisit") != ("warc-refers-to" in headers):
        raise ValueError(f"bad record type {kind!r}")
    declared = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(body) != declared or int(headers["x-payload-length"]) != length):
        raise ValueError("the payload does not match its digest or length")

    def page(name: str) -> int | None:
        value = headers[name].removeprefix("<urn:page:").removesuffix(">")
        return None if value == "none" else int(value)

    return {
        "page_id": page("warc-record-id"),
        "url": headers.get("warc-target-uri", ""),
        "payload_bytes": int(headers["x-payload-length"]),
        "payload_digest": declared,
        "record_type": kind,
        "refers_to": page("warc-refers-to") if kind == "revisit" else None,
        "payload": body if kind == "response" else None,
    }


def records(file: pa.NativeFile) -> Iterator[bytes]:
    """The decoded frames of an archive; holds one record and one block of the file."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != _DICTIONARY:
        raise ValueError("the archive does not begin with its dictionary")
    raw = file.read(size)
    dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = file.read(_READ)
    while rest:
        if len(rest) < 4:
            rest += file.read(_READ)
        if rest[:4] != _FRAME:
            raise ValueError("a record does not begin with a frame")
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := file.read(_READ)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        rest = rest or file.read(_READ)


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its digest; rows of equal content but unlike types meet nowhere else."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("same"),
    )


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write every page as a record; one row (file, records) per archive."""
    dictionary = train(pages, settings)
    given = _payloads(pages)
    # Only digests that occur more than once need a join; equal payloads are counted before the shuffle.
    groups = keep(
        given.where(F.octet_length("payload") >= settings.least_payload)
        .groupBy("same")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
        .where("n > 1")
        .select("same", "newest"),
        "payload-groups",
    )
    chosen = given.join(groups, "same", "left")
    revisit = F.col("newest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("newest")))
    chosen = chosen.select("page_id", "url", "payload", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        n = 0
        with new_file(folder, ".warc.zst") as (out, name):
            out.write(struct.pack("<II", _DICTIONARY, len(dictionary)) + dictionary)
            for batch in batches:
                for row in batch.to_pylist():
                    kind = "revisit" if row["again"] else "response"
                    out.write(compressor.compress(record(kind, row["page_id"], row["url"], row["payload"], row["refers_to"])))
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return keep(chosen.mapInArrow(run, "file string, records long"), "archives")


FIELDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives, checked."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                with open_file(folder, name) as file:
                    rows, n, size = [], 0, 0
                    for data in records(file):
                        rows.append(parse(data))
                        n, size = n + 1, size + len(data)
                        if len(rows) == 512 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if n != listed:
                        raise ValueError(f"{name} has {n} records, {listed} were written")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.repartition(max(1, files.count())).mapInArrow(run, FIELDS)
