"""A corpus pipeline over `documents`, of five of the operators in `threadhaul.llm`.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet, and read
again as the documents of the next one. All but the last return the columns of `documents`.

1. quality classifier: documents with a low chance of the highest grade go.
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: every secret is replaced by a mark; n_chars follows the text.
5. BPE encoding and decoding: ids and decoded text of what is left, by their digests.

Stages 1 to 3 judge each row; NULL texts and ids, repeated rows and empty tables are handled as
the operators say. The classifier is trained by itself, so that SQL cannot state the
result: ORACLE_SQL is None, and the tests hold the stages against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadhaul.llm import bpe_stream, decontaminate, ngram_join, ordinal_quality, secret_entropy
from threadhaul.llm.common import keep, prepared, table
from threadhaul.llm.queries import BYTE_BPE, ORACLES, QUERIES, vocabulary_path

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.score(docs, model).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return ngram_join.one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = secret_entropy.scan(docs).withColumn("text", secret_entropy.redacted(F.col("text"), F.col("all_spans")))
    n_chars = F.when(F.size("all_spans") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return bpe_stream.round_trip_digests(docs, vocabulary_path(BYTE_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES["pipeline"] = run
