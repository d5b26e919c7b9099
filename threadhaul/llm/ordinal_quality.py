"""Quality by ordinal regression on graded ratings.

Ratings give three grades: 0 toxic, 1 of low quality, 2 good. A cumulative-link model
P(grade <= k) = sigmoid(theta_k - w.x) shares one weight vector over hashed features of
the text among all grades and orders them by thresholds theta_0 < theta_1. From it come
the expected grade and the tail probability P(grade >= 2), by which documents are
selected.

Features (presence of each, hashed to `dimensions`): lower-cased words, the beginnings
of words (4 and 5 bytes), their last 2 bytes, whether a word repeats the one before, and how
dense capitals, symbols and repeated words are. Only features that depend on the grade in the sample (chi-square) get a weight.

The model is fitted on a bounded sample: the `train_rows` rated documents that come
first by a hash of their id. Everything else covers all rows.

Defined results: a NULL text has no features and gets the model's prior grade; a document
rated several times has its lowest grade; ratings without id or value are left out; with
no ratings at all the prior is grade 2 and nothing is rejected; repeated rows are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import keep, texts
from .words import Words, mixed, sliced

GRADES = 3
_CAPITALS, _SYMBOLS = np.zeros(256, np.int64), np.zeros(256, np.int64)
_CAPITALS[ord("A") : ord("Z") + 1] = 1
_SYMBOLS[list(b"!#$%&*+<=>@[]^_`{|}~")] = 1


@dataclass(frozen=True)
class Settings:
    train_rows: int = 6_144
    dimensions: int = 1 << 22
    steps: int = 120
    rate: float = 0.1
    # Features of fewer rated documents get no weight.
    least_documents: int = 3
    # Nor do features with a lower chi-square statistic: most words say nothing about quality.
    least_chi2: float = 60.0
    penalty: float = 1e-3
    least_tail: float = 0.35


def _densities(words: Words, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of how dense capitals, symbols and repeated words are, in steps of a tenth (none below one)."""
    n_bytes, n_words = np.maximum(np.diff(words.rows), 1), np.maximum(words.counts, 1)
    shares = [np.bincount(repeats, minlength=len(n_words)) / n_words]
    for table, scale in ((_CAPITALS, 1), (_SYMBOLS, 2)):
        total = np.concatenate(([0], np.cumsum(table[words.raw])))
        shares.append(scale * np.diff(total[words.rows]) / n_bytes)
    rows, hashes = [], []
    for kind, share in enumerate(shares):
        step = np.minimum(share * 10, 9).astype(np.int64)
        filled = np.flatnonzero(step)
        rows.append(filled)
        hashes.append(mixed((1_000 + 10 * kind + step[filled]).astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(hashes)


def feature_rows(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every feature present in a batch of texts, by row, each once."""
    words = Words(column, lower=True)
    row = words.row
    whole = words.hashes()
    kinds = [whole]
    starts, ends = words.starts, words.ends
    for size in (4, 5):
        words.starts, words.ends = starts, np.minimum(ends, starts + size)
        kinds.append(words.hashes())
    words.starts, words.ends = np.maximum(starts, ends - 2), ends
    kinds.append(words.hashes())
    words.starts, words.ends = starts, ends
    with np.errstate(over="ignore"):
        salted = [mixed(h + np.uint64(k)) for k, h in enumerate(kinds)]
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (row[1:] == row[:-1])) + 1
    salted.append(np.full(len(again), mixed(np.array([99], np.uint64))[0]))
    dense_row, dense = _densities(words, row[again])
    salted.append(dense)
    rows = np.concatenate([np.tile(row, len(kinds)), row[again], dense_row])
    index = np.concatenate(salted) & np.uint64(dimensions - 1)
    both = np.unique((rows.astype(np.uint64) << np.uint64(32)) | index)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one column each."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def telling_features(rows: np.ndarray, index: np.ndarray, grades: np.ndarray, settings: Settings) -> np.ndarray:
    """Features whose presence depends on the grade, by the chi-square statistic over the grades."""
    seen = np.bincount(index, minlength=settings.dimensions)
    often = np.flatnonzero(seen >= settings.least_documents)
    place = np.full(settings.dimensions, -1, np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    known = place[index]
    chosen = known >= 0
    cells = known[chosen].astype(np.int64) * GRADES + grades[rows[chosen]]
    counts = np.bincount(cells, minlength=GRADES * len(often)).reshape(-1, GRADES)
    n, seen = len(grades), seen[often]
    expected = seen[:, None] * np.bincount(grades, minlength=GRADES)[None, :] / n
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(expected > 0, (counts - expected) ** 2 / expected, 0.0)
        # Presence and absence together.
        chi2 = terms.sum(axis=1) * n / np.maximum(n - seen, 1)
    return often[chi2 >= settings.least_chi2]


def fit(rows: np.ndarray, index: np.ndarray, grades: np.ndarray, settings: Settings) -> Model:
    """Minimise the negative log likelihood by Adam over the whole sample in each step."""
    n = len(grades)
    model = Model(np.zeros(settings.dimensions, np.float32), np.array([-2.0, -1.0]))
    if not n:
        return model
    shares = np.clip([(grades <= k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    used = telling_features(rows, index, grades, settings)
    place = np.full(settings.dimensions, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    known = place[index] >= 0
    rows, column = rows[known], place[index[known]]
    del index, known, place
    # Weights, the first threshold, and the logarithm of the gap to the second.
    value = np.concatenate([np.zeros(len(used)), [first[0], np.log(max(first[1] - first[0], 1e-2))]])
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, settings.steps + 1):
        score = np.bincount(rows, weights=value[column], minlength=n)
        low, gap = value[-2], np.exp(value[-1])
        below = sigmoid(np.stack([low - score, low + gap - score], axis=1))
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = edges * (1 - edges)
        at = np.arange(n)
        likely = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-9)
        # Derivatives of the loss by the upper and the lower border of the grade.
        up, down = -slope[at, grades + 1] / likely, slope[at, grades] / likely
        by_score = -(up + down) / n
        gradient = np.empty_like(value)
        gradient[:-2] = np.bincount(column, weights=by_score[rows], minlength=len(used)) + settings.penalty * value[:-2]
        gradient[-2] = (up + down).sum() / n
        gradient[-1] = gap * (up[grades == 1].sum() + down[grades == 2].sum()) / n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        value -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.weights[used] = value[:-2]
    model.thresholds = np.array([value[-2], value[-2] + np.exp(value[-1])])
    return model


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of every rated document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
        .where("doc_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the sample; only its hashed features (at most `train_rows` rows) come to the driver."""
    rated = keep(
        grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_rows), "rated-sample"
    )
    dimensions = settings.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows, index = feature_rows(batch.column("text"), dimensions)
            cuts = np.searchsorted(rows, np.arange(len(batch) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), lists], ["doc_id", "grade", "features"])

    # A rated id with several rows counts once, with the text whose hash is smallest, in whatever order rows arrive.
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    sample = texts(docs).join(rated, "doc_id").groupBy("doc_id", "grade").agg(first.alias("text"))
    got = sample.mapInArrow(run, "doc_id long, grade int, features array<int>").toArrow().sort_by("doc_id")
    lists = got.column("features").combine_chunks()
    sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    index = lists.flatten().to_numpy(zero_copy_only=False)
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), index, got.column("grade").to_numpy().astype(np.int64), settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """`docs` with expected_grade, tail (probability of the highest grade) and kept."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    thresholds = model.thresholds
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(weights.value, thresholds)
        for batch in sliced(batches, "text"):
            column = batch.column(text).fill_null("")
            rows, index = feature_rows(column, len(known.weights))
            scores = np.bincount(rows, weights=known.weights[index], minlength=len(batch))
            tails = known.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*names, "expected_grade", "tail"]
            )

    schema = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())])
    return docs.mapInArrow(run, schema).withColumn("kept", F.col("tail") >= settings.least_tail)
