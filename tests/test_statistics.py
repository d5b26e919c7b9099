"""Statistics that follow the files of a table."""

import os

import pytest
from pyspark.sql import functions as F

from threadhaul import schemas as S
from threadhaul.operators.statistics import BINS, ColumnStatistics, estimated_anti_join


def rows(spark, low, high):
    """Numbers with every tenth missing, a skewed text, and times."""
    n = F.when(F.col("id") % 10 > 0, F.col("id"))
    text = F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.least(F.col("id"), F.lit(5000)).cast("string"))).otherwise("hot")
    return spark.range(low, high).select(n.alias("n"), text.alias("s"), F.timestamp_micros("id").alias("at"))


@pytest.fixture
def place(tmp_path):
    return tmp_path / "a folder"


def kept(spark, place):
    return ColumnStatistics(spark, str(place / "statistics"), {name: F.col(name) for name in ("n", "s", "at")})


def table(spark, place):
    return spark.read.schema("n long, s string, at timestamp").parquet(str(place / "table"))


def add(spark, place, low, high):
    rows(spark, low, high).coalesce(2).write.mode("append").parquet(str(place / "table"))


def known(statistics):
    return {r["name"]: r for r in statistics.merged().collect()}


def test_only_added_files_are_read(spark, place):
    statistics = kept(spark, place)
    add(spark, place, 0, 6000)
    first = statistics.update(table(spark, place))
    assert len(first) == 2 and statistics.update(table(spark, place)) == []
    # Unreadable from now on: whoever reads them again fails.
    for file in first:
        with open(file.removeprefix("file://"), "wb") as broken:
            broken.write(b"not parquet")
    add(spark, place, 6000, 20000)
    second = statistics.update(table(spark, place))
    assert len(second) == 2 and not set(first) & set(second)
    got = known(statistics)
    assert {name: (r["rows"], r["nulls"], r["low"], r["high"], r["longest"]) for name, r in got.items()} == {
        "n": (20000, 2000, 1, 19999, 8),
        "s": (20000, 0, None, None, 5),
        "at": (20000, 0, 0, 19999, 8),
    }
    assert got["n"]["bytes"] == 8 * 18000
    assert got["s"]["bytes"] == sum(3 if i % 3 == 0 else len(f"k{min(i, 5000)}") for i in range(20000))
    for name, true in (("n", 18000), ("s", 3334), ("at", 20000)):
        assert abs(got[name]["distinct"] - true) < 0.05 * true
    borders = got["n"]["borders"]
    assert len(borders) == BINS + 1 and (borders[0], borders[-1]) == (1, 19999) and got["s"]["borders"] is None
    assert max(abs(border - 20000 * i / BINS) for i, border in enumerate(borders)) < 0.02 * 20000


def test_rewritten_tables_are_read_anew(spark, place):
    statistics = kept(spark, place)
    add(spark, place, 0, 100)
    add(spark, place, 100, 200)
    assert len(statistics.update(table(spark, place))) == 4
    gone = next(p for p in os.listdir(place / "table") if p.endswith(".parquet"))
    os.unlink(place / "table" / gone)
    assert len(statistics.update(table(spark, place))) == 3
    assert known(statistics)["at"]["rows"] == table(spark, place).count() < 200


def test_a_set_that_was_not_finished_does_not_count(spark, place):
    statistics = kept(spark, place)
    add(spark, place, 0, 100)
    statistics.update(table(spark, place))
    add(spark, place, 100, 200)
    statistics.update(table(spark, place))
    newest = max((place / "statistics").iterdir(), key=lambda p: p.stat().st_mtime)
    os.unlink(newest / "_SUCCESS")
    assert known(statistics)["at"]["rows"] == 100
    assert len(statistics.update(table(spark, place))) == 2
    assert known(statistics)["at"]["rows"] == 200


def test_tables_without_rows_or_values(spark, place):
    statistics = kept(spark, place)
    assert statistics.merged().count() == 0
    spark.createDataFrame([], "n long, s string, at timestamp").write.parquet(str(place / "table"))
    statistics.update(table(spark, place))
    spark.createDataFrame([(None, None, None)], "n long, s string, at timestamp").write.mode("append").parquet(str(place / "table"))
    statistics.update(table(spark, place))
    for row in known(statistics).values():
        assert (row["rows"], row["nulls"], row["distinct"], row["low"], row["borders"]) == (1, 1, 0, None, None)
    missing = estimated_anti_join(statistics.merged(), "n", statistics.merged(), "s")
    assert missing.first()["missing"] == 0


def test_the_worklist_is_estimated(spark, store, roster_folder):
    users = spark.range(4000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias(S.ROSTER_KEY[0]), "id")
    assert store.pending_estimate() == 0
    missing = [f.name for f in S.ROSTER.fields if f.name not in users.columns]
    roster = users.withColumns({name: F.lit(None).cast("string") for name in missing})
    store.upsert_roster(roster.withColumns({"file_path": F.lit(""), "block_start": F.lit(0), "position": F.lit(0)}))
    for number, share in ((1, 1000), (2, 3000), (3, 4000)):
        store.commit_progress(users.where(F.col("id") < share), S.ROSTER_KEY[0])
        true = 4000 - share
        assert abs(store.pending_estimate() - true) < 0.05 * 4000
        assert store.refresh_statistics(S.ROSTER_TABLE) == store.refresh_statistics(S.PROGRESS_TABLE) == 0
    place = store.column_statistics(S.PROGRESS_TABLE).place
    store.reset_tables()
    assert not os.path.exists(place.removeprefix("file:"))
