"""Whole-file readers with a wildcard on the full name below a root folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wildcard_match


class EmptySourceError(ValueError):
    """The source folder holds no data file at all."""


def _root_path(spark: SparkSession, root: str) -> str:
    """The root as file listings name it: absolute, without scheme, `//` or `..`, and with a slash at the end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder)
    return qualified.toUri().getPath().rstrip("/") + "/"


def _relative_name(path: Column, root: str) -> Column:
    """Name of a file below the root (from `_root_path`), as the wildcard sees it; a path elsewhere is an error."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    elsewhere = F.raise_error(F.concat(F.lit(f"not below {root}: "), path)).cast("string")
    return F.when(plain.startswith(root), F.substr(plain, F.lit(len(root) + 1))).otherwise(elsewhere)


def _decoded(path: Column) -> Column:
    """File paths in text metadata are percent-encoded; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """`(file_path, value)`: each non-empty file as one string."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(_decoded(F.col("_metadata.file_path")).alias("file_path"), "value")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """`(file_path, length, content)`: each non-empty file as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), "length", "content")


@dataclass(frozen=True)
class Listing:
    """The files of a root folder by number and size, and those that match; from one listing, nothing being read."""

    files: int
    largest: int
    bytes: int


def list_matching(spark: SparkSession, root: str, pattern: str) -> Listing:
    """One listing for all that is asked of it: folders of many files take long to list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    matching = F.when(wildcard_match(_relative_name(F.col("path"), _root_path(spark, root)), pattern), F.col("length"))
    found = files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.max(matching), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(matching), F.lit(0)).alias("bytes"),
    )
    return Listing(**found.first().asDict())


def matching_bytes(spark: SparkSession, root: str, pattern: str) -> int:
    """Total size of the matching files, from their listing alone."""
    return list_matching(spark, root, pattern).bytes


def require_files(spark: SparkSession, root: str, listing: Listing | None = None) -> None:
    """Refuse a root folder without any file; only names are listed, nothing is read."""
    if listing is not None:
        empty = not listing.files
    else:
        empty = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").isEmpty()
    if empty:
        raise EmptySourceError(f"no files below {root}")


def scan_wildcard_files(spark: SparkSession, root: str, pattern: str, listing: Listing | None = None) -> DataFrame:
    """`(name, size, file_path, value)` of the files whose name below `root` matches.

    The predicate is on file metadata, so files that do not match are left out
    before any is opened. An empty root is an error, a root without a match is not.
    """
    if not pattern:
        raise ValueError("the file name pattern is missing")
    require_files(spark, root, listing)
    path = _decoded(F.col("_metadata.file_path"))
    name = _relative_name(path, _root_path(spark, root))
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .where(wildcard_match(name, pattern))
        .select(
            name.alias("name"),
            F.col("_metadata.file_size").alias("size"),
            path.alias("file_path"),
            "value",
        )
    )


def scan_wildcard_lines(spark: SparkSession, root: str, pattern: str, listing: Listing | None = None) -> DataFrame:
    """Like `scan_wildcard_files`, one row per line, so that large files are split."""
    if not pattern:
        raise ValueError("the file name pattern is missing")
    require_files(spark, root, listing)
    path = _decoded(F.col("_metadata.file_path"))
    name = _relative_name(path, _root_path(spark, root))
    return (
        spark.read.text(root, recursiveFileLookup=True)
        .where(wildcard_match(name, pattern))
        .select(
            name.alias("name"),
            F.col("_metadata.file_block_start").alias("block_start"),
            "value",
        )
    )


def block_pieces(spark: SparkSession, root: str, pattern: str, end: str = "}", listing: Listing | None = None) -> DataFrame:
    """`(file_path, block_start, value)`: what stands between two `end` characters, in order within each block.

    Large files are split, whether they have lines or not.
    """
    if not pattern:
        raise ValueError("the file name pattern is missing")
    require_files(spark, root, listing)
    path = _decoded(F.col("_metadata.file_path"))
    name = _relative_name(path, _root_path(spark, root))
    return (
        spark.read.text(root, lineSep=end, recursiveFileLookup=True)
        .where(wildcard_match(name, pattern))
        .select(path.alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")
    )
