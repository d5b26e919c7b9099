"""Table administration, on tables filled from the given ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.statistics import BINS, ColumnStatistics
from ..runtime import scratch
from ..settings import ExportSettings
from ..tables import ChatStore
from .derived import progress, roster
from .registry import Tables, query


def _store(t: Tables) -> ChatStore:
    """A database whose roster and progress tables hold customers and orders."""
    place = scratch(t.spark, "database")
    settings = ExportSettings(
        database=place.rsplit("/", 1)[1].replace("-", "_"), database_location=place
    )
    store = ChatStore(t.spark, settings)
    store.ensure_tables()
    store.set_version()
    rows = roster(t).withColumns(
        {"file_path": F.lit(""), "block_start": F.lit(0), "position": F.lit(0)}
    )
    store.upsert_roster(rows)
    store.commit_progress(progress(t).where("type = 'user'").select("value"), "value")
    return store


def _rows(store: ChatStore, *tables: str):
    counts = [
        store.read(table).agg(F.count("*").alias("rows")).select(F.lit(table).alias("name"), "rows")
        for table in tables
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


_COUNTS_SQL = f"""SELECT '{S.ROSTER_TABLE}' AS name, count(*) AS rows FROM customer
UNION ALL SELECT '{S.PROGRESS_TABLE}', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT '{S.MESSAGE_TABLE}', 0"""


@query(_COUNTS_SQL)
def ensure_tables(t: Tables):
    """Tables are created once; asking again leaves their rows alone."""
    store = _store(t)
    store.ensure_tables()
    return _rows(store, S.ROSTER_TABLE, S.PROGRESS_TABLE, S.MESSAGE_TABLE)


@query(f"""SELECT '{S.ROSTER_TABLE}' AS name, count(*) AS before, CAST(0 AS BIGINT) AS rows,
  CAST(NULL AS VARCHAR) AS version FROM customer""")
def reset_tables(t: Tables):
    """Reset drops the rows and the version."""
    store = _store(t)
    before = store.read(S.ROSTER_TABLE).count()
    store.reset_tables()
    store.ensure_tables()
    return _rows(store, S.ROSTER_TABLE).select(
        "name",
        F.lit(before).cast("bigint").alias("before"),
        "rows",
        F.lit(store.version()).cast("string").alias("version"),
    )


@query(f"""SELECT '{S.SCHEMA_VERSION}' AS version, count(*) AS rows FROM customer""")
def schema_version_check(t: Tables):
    store = _store(t)
    version = store.check_version()
    return _rows(store, S.ROSTER_TABLE).select(F.lit(version).alias("version"), "rows")


@query(f"SELECT '{S.ROSTER_TABLE}' AS name, count(*) AS rows FROM customer")
def analyze_table(t: Tables):
    """The row count the optimizer knows after the statistics were refreshed."""
    store = _store(t)
    store.analyze(S.ROSTER_TABLE)
    detail = t.spark.sql(f"DESCRIBE TABLE EXTENDED {store.name(S.ROSTER_TABLE)}")
    known = F.regexp_extract("data_type", r"(\d+) rows", 1).cast("bigint")
    return detail.where("col_name = 'Statistics'").select(
        F.lit(S.ROSTER_TABLE).alias("name"), known.alias("rows")
    )


_SKETCHED = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderdate": "CAST(epoch_us(o_orderdate) AS BIGINT)"}


def _order_statistics(t: Tables) -> tuple[ColumnStatistics, list[int]]:
    """Statistics of orders that are added in two halves, and how many files were read for each."""
    folder, read = scratch(t.spark, "orders"), []
    kept = ColumnStatistics(t.spark, scratch(t.spark, "statistics"), {name: F.col(name) for name in [*_SKETCHED, "o_orderstatus"]})
    for half in (0, 1):
        t.orders.where(F.col("o_orderkey") % 2 == half).coalesce(1).write.mode("append").parquet(folder)
        read.append(len(kept.update(t.spark.read.schema(t.orders.schema).parquet(folder))))
    return kept, read


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS name, count(*) AS rows, count(*) - count({name}) AS nulls, min({number}) AS low, max({number}) AS high,
  {longest} AS longest, true AS distinct_close, true AS borders_close, 2 AS files_read
FROM orders"""
        for name, number, longest in [*((n, sql, 8) for n, sql in _SKETCHED.items()), ("o_orderstatus", "CAST(NULL AS BIGINT)", 1)]
    )
)
def column_statistics(t: Tables):
    """Sketched statistics of files added one after another, against exact counts: distinct keys within 5 percent, bin borders within
    2 percent of the rows, and each file read once."""
    kept, read = _order_statistics(t)
    merged = kept.merged()
    exact, shares = [], []
    for name in [*_SKETCHED, "o_orderstatus"]:
        exact.append(t.orders.agg(F.lit(name).alias("name"), F.countDistinct(name).alias("true_distinct")))
    for name in _SKETCHED:
        borders = merged.where(F.col("name") == name).select("borders").scalar()
        number = F.unix_micros(F.col(name).cast("timestamp")) if name == "o_orderdate" else F.col(name)
        valued = t.orders.select(number.alias("value"), borders.alias("borders"))
        # How many borders a row has below it, and below or at it: at most two groups per border.
        places = valued.groupBy(
            F.size(F.filter("borders", lambda one: one < F.col("value"))).alias("above"),
            F.size(F.filter("borders", lambda one: one <= F.col("value"))).alias("reached"),
        ).agg(F.count(F.lit(1)).alias("n"))
        places = places.agg(F.collect_list(F.struct("above", "reached", "n")).alias("places"), F.sum("n").alias("all"))

        def share(of: str, number: Column) -> Column:
            chosen = F.filter("places", lambda place: place[of] <= number)
            return F.aggregate(chosen, F.lit(0).cast("long"), lambda sum_, place: sum_ + place["n"]) / F.col("all")

        def off(number: Column) -> Column:
            """How far a border is from its rank; it may lie anywhere among the rows of its value."""
            return F.greatest(share("reached", number) - number / BINS, number / BINS - share("above", number), F.lit(0.0))

        worst = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(BINS)), off))
        shares.append(places.select(F.lit(name).alias("name"), (worst < 0.02).alias("borders_close")))

    found = merged.join(reduce(DataFrame.unionByName, exact), "name").join(reduce(DataFrame.unionByName, shares), "name", "left")
    close = F.abs(F.col("distinct") - F.col("true_distinct")) <= 0.05 * F.col("true_distinct")
    return found.select(
        "name", "rows", "nulls", "low", "high", "longest", close.alias("distinct_close"),
        F.coalesce("borders_close", F.lit(True)).alias("borders_close"), F.lit(sum(read)).alias("files_read"),
    )


@query("""SELECT count(*) AS pending, true AS estimate_close FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def pending_estimate(t: Tables):
    """The size of the worklist from statistics alone, within 5 percent of the roster of the true one."""
    store = _store(t)
    estimate = store.pending_estimate()
    rows, done = store.read(S.ROSTER_TABLE), store.read(S.PROGRESS_TABLE)
    pending = rows.join(done, F.col(S.ROSTER_KEY[0]) == F.col("value"), "left_anti").agg(F.count("*").alias("pending"))
    close = F.abs(F.col("pending") - F.lit(estimate)) <= 0.05 * rows.agg(F.count("*")).scalar()
    return pending.select("pending", close.alias("estimate_close"))
