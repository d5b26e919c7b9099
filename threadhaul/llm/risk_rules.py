"""Quality rules whose cutoffs come with a guarantee on the clean documents they reject.

Each rule rejects a document whose measure (a ratio) exceeds a cutoff. For each
stratum (language) and rule, cutoffs of a fixed grid are tested from the mildest to
the strictest on labelled clean documents: with k of n above the cutoff, the exact
binomial tail P(Bin(n, alpha) <= k) is a p-value for "more than alpha of the clean
documents are rejected". Testing in this fixed order ends at the first cutoff that is
not shown safe, so the order itself costs nothing; the level delta is shared among
all strata and rules (Bonferroni). With probability 1 - delta, no rule of any
stratum rejects more than `alpha` of its clean documents; together at most
`alpha` times the number of rules. A stratum with too few labels gets no cutoff,
so that the rule rejects nothing there.

Defined results: a NULL text has no words; a NULL language is a stratum of its own; a
document with several labels is clean only if all of them say so; repeated rows are
judged each; an empty table of labels gives no cutoff at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .words import Words, mixed, sliced, windows

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """alpha: share of the clean documents a rule may reject; delta: chance that this is exceeded anywhere."""

    alpha: float = 0.005
    delta: float = 0.05
    min_words: int = 20
    repeat_percent: int = 30
    # From the mildest to the strictest.
    cutoffs: tuple[float, ...] = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


_PARTS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}


def ratios() -> dict[str, Column]:
    """What each rule compares with its cutoff."""
    return {name: _ratio(F.col(part), F.col(whole)) for name, (part, whole) in _PARTS.items()}


def _repeated_words(words: Words) -> np.ndarray:
    """Per row, the words in windows found twice or more in it."""
    n_rows, row = len(words.counts), words.row
    out = np.zeros(n_rows, np.int64)
    if len(words) < WINDOW:
        return out
    hashed = windows(words.hashes(), WINDOW)
    place = np.flatnonzero(row[: len(hashed)] == row[WINDOW - 1 :])
    if not len(place):
        return out
    with np.errstate(over="ignore"):
        key = mixed(hashed[place] + mixed(row[place].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(words) + 1, np.int64)
    hit = place[order[twice]]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    np.add.at(out, row[covered], 1)
    return out


def _lines(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per row, its lines with a word, and those of them equal to an earlier line."""
    lines, repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        full = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
        lines[i] = len(full)
        repeated[i] = len(full) - len(set(full))
    return lines, repeated


def measured_batch(column: pa.Array) -> dict[str, np.ndarray]:
    words = Words(column)
    data = words.data
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOLS[data], out=symbols[1:])
    per_word = np.zeros(len(words) + 1, np.int64)
    np.cumsum(points[words.ends] - points[words.starts], out=per_word[1:])
    whole = data.tobytes()
    rows = words.rows
    texts = [whole[a:b] for a, b in zip(rows[:-1], rows[1:])]
    lines, repeated = _lines(words, texts)
    return {
        "n_words": words.counts,
        "word_chars": per_word[words.first[1:]] - per_word[words.first[:-1]],
        "n_symbols": symbols[rows[1:]] - symbols[rows[:-1]],
        "n_dup_lines": repeated,
        "n_repeat_words": _repeated_words(words),
        "n_lines": lines,
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found = measured_batch(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("stratum"), *(pa.array(v, pa.int64()) for v in found.values())],
            ["doc_id", "stratum", *found],
        )


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The measures of every document, with its id and stratum."""
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return plain.mapInArrow(_measure, f"doc_id long, stratum string, {MEASURES}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly term by term."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)))) + n * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def safe_cutoff(above: list[int], n: int, alpha: float, level: float, cutoffs: tuple[float, ...]) -> float | None:
    """The strictest cutoff reached before the first one not shown safe; `above[i]` of n exceed `cutoffs[i]`."""
    found = None
    for cutoff, k in zip(cutoffs, above):
        if k > alpha * n or binomial_tail(k, n, alpha) > level:
            break
        found = cutoff
    return found


def clean_labels(labels: DataFrame) -> DataFrame:
    """Ids of the documents that every one of their labels calls good and not toxic."""
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
        .where("q = 1 AND t = 0")
        .select(F.col("doc_id").cast("long").alias("doc_id"))
    )


def cutoffs(measures: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row (stratum, symbols, dup_lines, repeats) of safe cutoffs per stratum; NULL where none is shown safe.

    The holdout is reduced to counts per stratum before anything leaves the tasks.
    """
    clean = measures.join(clean_labels(labels), "doc_id", "left_semi")
    above = [
        F.sum((ratio > cutoff).cast("long")).alias(f"{name}_{i}")
        for name, ratio in ratios().items()
        for i, cutoff in enumerate(rules.cutoffs)
    ]
    counted = keep(clean.groupBy("stratum").agg(F.count("*").alias("n"), *above), "quality-holdout")
    # Strata with labels, times rules, share the level.
    level = rules.delta / (max(1, counted.count()) * len(_PARTS))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"stratum": frame["stratum"]}
            for name in _PARTS:
                out[name] = [
                    safe_cutoff(
                        [int(r[f"{name}_{i}"]) for i in range(len(rules.cutoffs))],
                        int(r["n"]),
                        rules.alpha,
                        level,
                        rules.cutoffs,
                    )
                    for _, r in frame.iterrows()
                ]
            yield pd.DataFrame(out).astype({name: "float64" for name in _PARTS})

    return counted.mapInPandas(choose, "stratum string, " + ", ".join(f"{name} double" for name in _PARTS))


def apply_rules(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), stratum: str = "lang") -> DataFrame:
    """Per document its measures, `base_failed`, the `reasons` of the method, and `kept`."""
    measures = keep(measure(docs, stratum), "quality-measures")
    limits = cutoffs(measures, labels, rules).select(
        F.col("stratum").alias("of"), *(F.col(name).alias(f"{name}_cutoff") for name in _PARTS)
    )
    limits = keep(limits, "quality-cutoffs")
    # NaN comes from a missing value in pandas.
    exceeds = {
        name: F.coalesce((ratio > F.col(f"{name}_cutoff")) & ~F.isnan(f"{name}_cutoff"), F.lit(False))
        for name, ratio in ratios().items()
    }
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")
    )
    reasons = F.array_compact(F.array(*(F.when(over, F.lit(name)) for name, over in exceeds.items())))
    return (
        measures.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
        .withColumn("base_failed", base)
        .withColumn("reasons", reasons)
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
        .drop("of")
    )
