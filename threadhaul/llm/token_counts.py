"""Token counts of whole texts by a piece vocabulary, without materialising ids.

No piece of the vocabulary reaches past the end of a word into the next white space,
and none contains a line feed, so that merges never cross these borders: the count
of a text is the sum over its pre-tokens (a run of spaces with the word behind it, or
a line feed). Each distinct pre-token is counted once, by the tokenizer library, and
joined to the frequencies of the pre-tokens per document. The most frequent ones
(at most `frequent`, each of at most `frequent_chars` characters) are joined in the
tasks that cut the texts, from a broadcast of bounded size; all others by a shuffle
join on the pre-token.

Defined results: a NULL text counts as empty and has no token; repeated rows and rows
without id are each counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, texts

_MARK = "▁"  # stands for a space in pieces
_CUT = re.compile(f"{_MARK}*[^{_MARK}\n]+|\n|{_MARK}+")
# Distinct pre-tokens a task gathers before it hands them on.
_GATHER = 200_000


@dataclass(frozen=True)
class Settings:
    frequent: int = 1 << 18
    frequent_chars: int = 40


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise unless pre-tokens can be counted on their own with this vocabulary."""
    model = _model(path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if re.search(f"[^{_MARK}]{_MARK}|\n", piece):
            raise ValueError(f"piece {piece!r} crosses the border of a pre-token")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; the library puts one space before it, unless it is empty."""
    return _CUT.findall(_MARK + text.replace(" ", _MARK)) if text else []


def count_pieces(tokens: list[str], path: str) -> list[int]:
    """The number of pieces of each pre-token, as it stands inside a text.

    The library adds a space in front of what it encodes: pre-tokens lose theirs first,
    and those without one (after a line feed) get a line feed, which stays a token.
    """
    model = _model(path)
    given, extra = [], []
    for token in tokens:
        if token == "\n":
            given.append("a\n"), extra.append(len(model.encode("a")))
        elif token == _MARK:
            given.append("a "), extra.append(len(model.encode("a")))
        elif token[0] == _MARK:
            given.append(token[1:].replace(_MARK, " ")), extra.append(0)
        else:
            given.append("\n" + token), extra.append(len(model.encode("\n")))
    return [len(ids) - less for ids, less in zip(model.encode(given, num_threads=1), extra)]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"]
        )

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(pre_tokens(text))
            if len(seen) > _GATHER:
                yield out(seen)
                seen = Counter()
    yield out(seen)


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """The distinct pre-tokens (token, n, pieces) of all texts, each counted once."""
    distinct = (
        texts(docs).select("text").mapInArrow(_vocabulary, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = count_pieces(batch.column("token").to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("token"), batch.column("n"), pa.array(counted, pa.int64())], ["token", "n", "pieces"]
            )

    return distinct.mapInArrow(pieces, "token string, n long, pieces long")


def _frequent(known: DataFrame, settings: Settings) -> dict[str, int]:
    """At most `frequent` of the most frequent pre-tokens, and the pieces of each.

    A histogram of rounded frequencies gives the limit, so that only the chosen rows are collected.
    """
    step = F.floor(F.log2("n") * 8)
    short = known.where(F.length("token") <= settings.frequent_chars)
    sizes = {r.step: r.rows for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}
    limit, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > settings.frequent:
            break
        limit = at
    if limit is None:
        return {}
    chosen = short.where(step >= limit).select("token", "pieces").toArrow()
    return dict(zip(chosen.column("token").to_pylist(), chosen.column("pieces").to_pylist()))


def token_counts(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8) and n_tokens."""
    check_model(path)
    spark = docs.sparkSession
    known = keep(vocabulary(docs, path), "pre-tokens")
    frequent = spark.sparkContext.broadcast(_frequent(known, settings))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            sizes, sums, rare, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = Counter(pre_tokens(text))
                total, names, counts = 0, [], []
                for token, n in found.items():
                    pieces = table.get(token)
                    if pieces is None:
                        names.append(token)
                        counts.append(n)
                    else:
                        total += n * pieces
                sizes.append(len(text.encode()))
                sums.append(total)
                rare.append(names)
                times.append(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rare, pa.list_(pa.string())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n_bytes", "total", "tokens", "times"],
            )

    # The row number tells repeated ids apart; it is fixed by the file's blocks.
    per_doc = (
        texts(docs)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, "row long, doc_id long, n_bytes long, total long, tokens array<string>, times array<long>")
    )
    each = per_doc.select(
        "row", "doc_id", "n_bytes", "total", "times", F.posexplode_outer("tokens").alias("at", "found")
    ).select(
        "row",
        "doc_id",
        "n_bytes",
        F.when(F.coalesce("at", F.lit(0)) == 0, F.col("total")).otherwise(0).alias("total"),
        F.when(F.col("at").isNotNull(), F.get("times", F.col("at"))).alias("times"),
        # A document without rare pre-tokens has one row, under a key that no pre-token equals.
        F.coalesce("found", F.concat(F.lit("\n"), F.col("row").cast("string"))).alias("found"),
    )
    counted = each.join(known.select(F.col("token").alias("found"), "pieces"), "found", "left")
    return (
        counted.groupBy("row", "doc_id", "n_bytes")
        .agg(F.sum(F.col("total") + F.coalesce(F.col("times") * F.col("pieces"), F.lit(0))).alias("n_tokens"))
        .drop("row")
    )
