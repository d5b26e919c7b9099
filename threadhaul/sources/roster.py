"""Roster files: JSON arrays of mailbox objects, names in any letter case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import is_blank

_FIELDS = S.ROSTER.fieldNames()

# Later files win over earlier ones, later objects over earlier ones of a file.
ROSTER_ORDER = ["file_path", "block_start", "position"]


@dataclass(frozen=True)
class Roster:
    """Accepted mailboxes, and the rejected objects as JSON."""

    mailboxes: DataFrame
    quarantine: DataFrame


RAW = "raw"  # the element as it was read


def _fields(element: Column) -> list[Column]:
    lowered = F.transform_keys(element, lambda key, _: F.lower(key))
    return [F.element_at(lowered, F.lit(name.lower())).alias(name) for name in _FIELDS]


def roster_rows(files: DataFrame, strict: bool = True) -> DataFrame:
    """`(file_path, block_start, position, roster columns)` of every array element.

    A file that is no JSON array is an error. A null element is an error in
    strict mode, otherwise a row of nulls that ends up in quarantine.
    """
    parsed = F.from_json(
        "value", "array<map<string,string>>", {"allowComments": "true", "mode": "PERMISSIVE"}
    )
    elements = files.select(
        "file_path",
        F.posexplode(
            F.coalesce(
                parsed,
                F.raise_error(F.concat(F.lit("not a JSON array: "), "file_path")).cast(
                    "array<map<string,string>>"
                ),
            )
        ).alias("position", "element"),
    )
    if strict:
        elements = elements.withColumn(
            "element",
            F.when(F.col("element").isNotNull(), F.col("element")).otherwise(
                F.raise_error(F.concat(F.lit("null roster object in "), "file_path")).cast(
                    "map<string,string>"
                )
            ),
        )
    return elements.select(
        "file_path",
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("position").cast("bigint").alias("position"),
        *_fields(F.col("element")),
        F.to_json("element", {"ignoreNullFields": "false"}).alias(RAW),
    )


def roster_rows_from_elements(elements: DataFrame, strict: bool = True) -> DataFrame:
    """The same rows from the elements of split arrays (`json_split.array_elements`).

    An element that is no object is an error in strict mode, otherwise a row of nulls (quarantine).
    """
    element = F.from_json("element", "map<string,string>", {"allowComments": "true"})
    if strict:
        problem = F.raise_error(F.concat(F.lit("null roster object in "), "file_path")).cast("map<string,string>")
        element = F.when(element.isNotNull(), element).otherwise(problem)
    parsed = elements.select("file_path", "block_start", "position", element.alias("element"))
    return parsed.select(
        "file_path",
        "block_start",
        "position",
        *_fields(F.col("element")),
        F.to_json("element", {"ignoreNullFields": "false"}).alias(RAW),
    )


def roster_rows_from_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """The same rows from files with one object per line, which Spark can split.

    Lines of one file are ordered by the block they lie in, then by their place
    in it. A line that is no object is an error in strict mode, otherwise a row of nulls
    (quarantine). Empty lines and comment lines hold nothing.
    """
    element = F.from_json("value", "map<string,string>", {"allowComments": "true"})
    lines = lines.where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    if strict:
        problem = F.raise_error(F.concat(F.lit("not a roster object: "), "value")).cast("map<string,string>")
        element = F.when(element.isNotNull(), element).otherwise(problem)
    return lines.select(
        F.col("name").alias("file_path"),
        "block_start",
        F.monotonically_increasing_id().alias("position"),
        *_fields(element),
        F.col("value").alias(RAW),
    )


def split_roster(rows: DataFrame) -> Roster:
    """Keep the rows that have an id; hand the others on as JSON."""
    key = F.col(S.ROSTER_KEY[0])
    rejected = rows.where(is_blank(key)).select(
        "file_path",
        "position",
        F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).alias("object"),
        RAW,
    )
    return Roster(rows.where(~is_blank(key)).drop(RAW), rejected)
