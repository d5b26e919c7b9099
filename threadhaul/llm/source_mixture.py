"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words: its weight's share of a total, never more than a
multiple of what it has; what it cannot take is shared among the others by weight, until
no target is above its limit. The limits are met in rounds, each one aggregate over the
table of sources, which is never collected.

A document's expected copies are target / size of its source. The documents of a source
are put in the order of their sizes, the expected copies are summed from the first on, one
random offset per source is added, and a document is taken once for each whole number that
the sum crosses at it. As sizes ascend, the words taken differ from the target by at most
the words of one document, the largest of the source. The sums are whole multiples of 2^-40,
so that no rounding moves a border, and `most` times is never exceeded.

The rows are numbered by `operators.ordinal`, which splits a large source among many tasks.

Defined results: a NULL text has no words; documents without words take part in the sums and
add nothing; a NULL source is a source of its own, the last one; ties of size are broken by id,
and rows equal in both share their copies among them in any order; repeated rows count each; an
empty table gives no rows. `mixed` hands through all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal
from .common import keep

_WORD = r"[^\x20\x09-\x0D]+"
# Parts of one copy that expected copies are counted in.
_COPY = 1 << 40


@dataclass(frozen=True)
class Mixture:
    """weights: of the sources in order, repeating. share: of all words. most: times that a source is taken."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: int = 0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """Per source its weight, its words (source_size) and its target; `rows` have source and size."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    weight = F.get(F.array(*map(F.lit, mixture.weights)), ((F.col("place") - 1) % len(mixture.weights)).cast("int"))
    placed = with_ordinal(keep(totals, "mixture-totals"), [], ["none", "source"], "place").withColumn("weight", weight)
    sources = keep(placed.select("source", "source_size", "weight"), "mixture-sources")

    whole = sources.agg(F.sum("source_size").alias("size")).first().size or 0
    limit, full = mixture.most * F.col("source_size"), -1
    rest, weights = 0.0, 0
    above = F.lit(False)
    while True:
        found = sources.agg(
            F.count_if(above).alias("full"),
            F.sum(F.when(above, limit)).alias("taken"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
        ).first()
        if found.full == full:
            break
        full, rest, weights = found.full, mixture.share * whole - (found.taken or 0), found.weights or 0
        part = F.lit(rest) * F.col("weight") / F.lit(float(max(weights, 1)))
        above = part > limit
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(part))


def _offset(mixture: Mixture) -> Column:
    """The random offset of a source, below one copy."""
    digest = F.sha2(F.concat(F.lit(f"{mixture.seed}:"), F.coalesce("source", F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("decimal(13,0)")


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, source, size (its words), and the whole `row`."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        F.struct("*").alias("row"),
    )


def copies(rows: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """`rows` (doc_id, source, size) with source_size, target, the copies that the mix has of each, and taken (size * copies)."""
    targets = source_targets(rows, mixture).select(F.col("source").alias("of"), "source_size", "target")
    placed = with_ordinal(rows, ["source"], ["size", "doc_id"], "place")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * _COPY)).otherwise(0)

    def crossed(place: Column) -> Column:
        total = _offset(mixture) + expected.cast("decimal(14,0)") * place.cast("decimal(19,0)")
        return F.call_function("div", total, F.lit(_COPY).cast("decimal(13,0)"))

    taken = joined.withColumn("copies", (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("int"))
    return taken.drop("place").withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, mixture: Mixture = Mixture(), id_column: str = "doc_id") -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken."""
    taken = copies(sized(docs, id_column), mixture).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def taken_words(docs: DataFrame, mixture: Mixture = Mixture(), id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies and taken; texts are read once."""
    return copies(keep(sized(docs, id_column).drop("row"), "mixture-sizes"), mixture)
