"""Files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch
from ..sources import files as R
from ..sources import roster as O
from ..sources.json_split import array_elements
from .registry import Tables, query, text

ROWS_PER_FILE = 2000
OBJECTS_PER_FILE = 500


def _document_files(t: Tables) -> str:
    """Documents as text files of bounded size, one folder per language."""
    path = scratch(t.spark, "documents")
    (
        t.documents.select("lang", "text")
        .write.partitionBy("lang")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .text(path)
    )
    return path


def _lang():
    return F.regexp_extract("file_path", "lang=([^/]*)/", 1).alias("lang")


@query("""SELECT lang, sum(strlen(text) + 1) AS bytes, sum(length(text) + 1) AS chars
FROM documents WHERE lower(lang) LIKE '%e%' GROUP BY lang""")
def scan_wildcard_files(t: Tables):
    found = R.scan_wildcard_files(t.spark, _document_files(t), "LANG=*e*/PART-*.txt")
    return found.groupBy(F.regexp_extract("name", "^lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("size").alias("bytes"), F.sum(F.length("value")).cast("bigint").alias("chars")
    )


@query("""SELECT lang, sum(strlen(text) + 1) AS bytes, sum(length(text) + 1) AS chars
FROM documents GROUP BY lang""")
def read_whole_text(t: Tables):
    return R.read_whole_text(t.spark, _document_files(t)).groupBy(_lang()).agg(
        F.sum(F.octet_length("value")).cast("bigint").alias("bytes"),
        F.sum(F.length("value")).cast("bigint").alias("chars"),
    )


@query("""SELECT lang, sum(strlen(text) + 1) AS bytes, sum(strlen(text) + 1) AS listed
FROM documents GROUP BY lang""")
def read_binary(t: Tables):
    return R.read_binary(t.spark, _document_files(t)).groupBy(_lang()).agg(
        F.sum(F.octet_length("content")).cast("bigint").alias("bytes"),
        F.sum("length").alias("listed"),
    )


def _roster_files(t: Tables) -> str:
    """Customers as roster files with comments and names in various cases.

    Customers in debt have no id, or an empty one.
    """
    debt = F.col("c_acctbal") < 0
    key = F.when(~debt, F.concat(F.lit("u"), "c_custkey")).when(F.col("c_nationkey") < 10, "")
    mail = F.concat("c_mktsegment", F.lit("@sample.com"))
    options = {"ignoreNullFields": "false"}

    def row(name: str, key_name: str, mail_name: str):
        return F.to_json(
            F.struct(F.col("c_name").alias(name), key.alias(key_name), mail.alias(mail_name)), options
        )

    shouting = row("DISPLAYNAME", "EXTERNALDIRECTORYOBJECTID", "PRIMARYSMTPADDRESS")
    usual = row("DisplayName", "externalDirectoryObjectId", "PrimarySmtpAddress")
    number = F.call_function("div", F.col("c_custkey"), F.lit(OBJECTS_PER_FILE))
    array = F.concat(
        F.lit("/* roster */ ["),
        F.array_join(F.collect_list("object"), ", // next\n"),
        F.lit("]"),
    )
    path = scratch(t.spark, "roster")
    (
        t.customer.select(
            number.alias("AllMailBoxes"),
            F.when(F.col("c_nationkey") % 2 == 0, shouting).otherwise(usual).alias("object"),
        )
        .groupBy("AllMailBoxes")
        .agg(array.alias("value"))
        .write.partitionBy("AllMailBoxes")
        .text(path)
    )
    return path


def _roster(t: Tables) -> O.Roster:
    files = R.scan_wildcard_files(t.spark, _roster_files(t), "allmailboxes*.txt")
    return O.split_roster(O.roster_rows(files))


@query("""SELECT c_name AS "DisplayName", 'u' || c_custkey AS "ExternalDirectoryObjectId",
  c_mktsegment || '@sample.com' AS "PrimarySmtpAddress" FROM customer WHERE c_acctbal >= 0""")
def roster_from_json(t: Tables) -> DataFrame:
    return _roster(t).mailboxes.drop(*O.ROSTER_ORDER)


@query("""SELECT '{"DisplayName":"' || c_name || '","ExternalDirectoryObjectId":' ||
  CASE WHEN c_nationkey < 10 THEN '""' ELSE 'null' END ||
  ',"PrimarySmtpAddress":"' || c_mktsegment || '@sample.com"}' AS object
FROM customer WHERE c_acctbal < 0""")
def roster_quarantine(t: Tables) -> DataFrame:
    return _roster(t).quarantine.select("object")


@query("""SELECT c_name AS "DisplayName", CASE WHEN c_acctbal >= 0 THEN 'u' || c_custkey WHEN c_nationkey < 10 THEN '' END
  AS "ExternalDirectoryObjectId", c_mktsegment || '@sample.com' AS "PrimarySmtpAddress" FROM customer""")
def roster_split_arrays(t: Tables) -> DataFrame:
    """The same roster files, each array cut among tasks."""
    size = "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(size)
    t.spark.conf.set(size, "4096")
    try:
        elements = array_elements(t.spark, _roster_files(t), "allmailboxes*.txt")
    finally:
        t.spark.conf.set(size, before)
    return O.roster_rows_from_elements(elements).select("DisplayName", "ExternalDirectoryObjectId", "PrimarySmtpAddress")


@query("""SELECT 'u' || c_custkey AS "ExternalDirectoryObjectId", c_name AS "DisplayName" FROM customer""")
def roster_from_lines(t: Tables) -> DataFrame:
    """One object per line: files of any size, which Spark can split."""
    path = scratch(t.spark, "roster-lines")
    objects = F.struct(
        F.concat(F.lit("u"), text("c_custkey")).alias("externaldirectoryobjectid"),
        F.col("c_name").alias("DISPLAYNAME"),
    )
    t.customer.select(F.to_json(objects)).write.text(path)
    lines = R.scan_wildcard_lines(t.spark, path, "part-*.TXT")
    return O.split_roster(O.roster_rows_from_lines(lines)).mailboxes.select(
        "ExternalDirectoryObjectId", "DisplayName"
    )
