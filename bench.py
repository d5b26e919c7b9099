"""Time every query, and the export end to end; prints one JSON line.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the cores. `BENCH_EXPORT=1` also
measures the export over copies of the input (rows per second, pages to stored
messages).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from threadhaul.queries import QUERIES, derived
from threadhaul.queries.registry import Tables
from threadhaul.plans.export import ChatExport, landed_pages_reader
from threadhaul.runtime import local_session, scratch
from threadhaul.settings import ExportSettings


def timed(action) -> float:
    begun = time.perf_counter()
    action()
    return round(time.perf_counter() - begun, 3)


def run_query(spark, name: str, folder: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def export_rate(spark, folder: str, copies: int) -> dict:
    """Messages per second from landed pages to the stored table, all users pending."""
    pages = derived.landed_pages(Tables(spark, folder))
    tag = F.concat(F.lit("c"), F.col("copy"))
    landing = scratch(spark, "bench-landing")
    many = pages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    many.withColumn("mailbox", F.concat(F.col("mailbox"), tag)).drop("copy").write.parquet(landing)
    place = scratch(spark, "bench-database")
    settings = ExportSettings(
        start="2023-01-01Z",
        end="2025-01-01Z",
        database=place.rsplit("/", 1)[1].replace("-", "_"),
        database_location=place,
    )
    export = ChatExport(spark, settings)
    export.store.ensure_tables()
    export.store.set_version()
    landed = spark.read.parquet(landing)
    users = landed.select(F.col("mailbox").alias("ExternalDirectoryObjectId")).distinct()
    export.store.upsert_roster(
        users.select(
            F.lit(None).cast("string").alias("DisplayName"),
            "ExternalDirectoryObjectId",
            F.lit(None).cast("string").alias("PrimarySmtpAddress"),
            F.lit("").alias("file_path"),
            F.lit(0).alias("block_start"),
            F.lit(0).alias("position"),
        )
    )
    begun = time.perf_counter()
    report = export.run(None, landed_pages_reader(landed))
    seconds = time.perf_counter() - begun
    return {
        "messages": report.messages,
        "sec": round(seconds, 3),
        "rows_per_sec": round(report.messages / seconds),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    # One query each of the JVM's and the Python workers' start-up, outside the times.
    for name in ("normalize_messages", "paged_source"):
        run_query(spark, name, folder)
    queries = {name: timed(lambda name=name: run_query(spark, name, folder)) for name in names}
    result = {
        "metric": "total time of all queries",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_EXPORT") == "1":
        result["export"] = {f"{n}x": export_rate(spark, folder, n) for n in (1, 10)}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
