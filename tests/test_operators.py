import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadhaul.operators import filters, merge, metrics
from threadhaul.operators import worklist as W
from threadhaul.operators.concat import string_concat_agg
from threadhaul.operators.dedupe import dedupe_first_wins, dedupe_last_wins
from threadhaul.operators.moving import warm_start_moving_avg
from threadhaul.operators.ordinal import paginate, rolling_series, with_ordinal
from threadhaul.operators.sqltext import parametrized_sql, scalar_datetime, scalar_int


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module", autouse=True)
def several_partitions(spark):
    """Small data would be put into one partition; here all of them are to be used."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key; values and order are shuffled."""
    draw = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{draw.randrange(200)}", i, draw.random()) for i in range(9000)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, n int, v double").repartition(6).cache()


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return {key: sorted(group, key=lambda r: r[1]) for key, group in groups.items()}


def test_dedupe_equals_brute_force(skewed):
    rows, df = skewed
    groups = by_key(rows)
    assert tuples(dedupe_first_wins(df, ["k"], ["n"])) == sorted((g[0] for g in groups.values()), key=repr)
    assert tuples(dedupe_last_wins(df, ["k"], ["n"])) == sorted((g[-1] for g in groups.values()), key=repr)


def test_ordinal_equals_brute_force(skewed):
    rows, df = skewed
    want = sorted(
        ((*row, place) for g in by_key(rows).values() for place, row in enumerate(g, 1)), key=repr
    )
    assert tuples(with_ordinal(df, ["k"], ["n"])) == want
    # Bounds within the hot group, next to small groups, and more parts than rows.
    for parts, part_rows in ((7, 100), (50, 10), (20_000, 1)):
        assert tuples(with_ordinal(df, ["k"], ["n"], parts=min(parts, 60), part_rows=part_rows)) == want


def test_ordinal_without_group_and_with_nulls(spark, skewed):
    rows, df = skewed
    for part_rows in (10_000, 500):
        got = with_ordinal(df, [], ["n"], part_rows=part_rows).select("n", "ordinal").collect()
        assert sorted((r["n"], r["ordinal"]) for r in got) == [(i, i + 1) for i in range(9000)]
    some = spark.createDataFrame([(None, 2), (None, 1), (None, None), ("a", 1)], "k string, n int")
    for part_rows in (10_000, 1):
        got = tuples(with_ordinal(some, ["k"], ["n"], parts=4, part_rows=part_rows))
        assert got == sorted([(None, None, 1), (None, 1, 2), (None, 2, 3), ("a", 1, 1)], key=repr)
    assert with_ordinal(some.where("n > 5"), ["k"], ["n"]).isEmpty()


def test_ordinal_with_equal_keys_and_many_kinds(spark):
    rows = spark.range(4000).selectExpr(
        "id % 3 AS k", "date_add(DATE'2024-01-01', CAST(id % 50 AS INT)) AS d", "CAST(id % 7 AS DECIMAL(9,2)) AS x", "id"
    )
    got = with_ordinal(rows, ["k"], ["d", "x"], parts=9, part_rows=10).collect()
    groups = by_key([(r.k, r.d, r.x, r.ordinal) for r in got])
    for group in groups.values():
        assert [r[3] for r in sorted(group, key=lambda r: r[1:])] == list(range(1, len(group) + 1))


def test_ordinal_spreads_a_hot_group_in_one_shuffle(spark):
    df = spark.range(9000).selectExpr("IF(id % 3 > 0, 'hot', CAST(id AS STRING)) AS k", "id AS n")
    numbered = with_ordinal(df, ["k"], ["n"], parts=8, part_rows=10)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(__part") == text.count("Exchange") == 1
    assert "Join" not in text and "checkpoint" not in text.lower()
    parts = numbered.withColumn("p", F.spark_partition_id()).where("k = 'hot'").select("p").distinct().count()
    assert parts > 1
    for paged in (paginate(df, "k", ["n"], 7), rolling_series(df, ["n"], 400)):
        assert paged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_ordinal_of_small_groups_is_a_plain_window(spark):
    """No bound is looked up for groups that need none; those of a large group beside them stay."""
    small = spark.range(9000).selectExpr("id % 500 AS k", "id AS n")
    numbered = with_ordinal(small, ["k"], ["n"], parts=8, part_rows=10)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    assert "__part" not in text and text.count("Exchange hashpartitioning(k") == text.count("Exchange") == 1
    assert tuples(numbered) == sorted(((i % 500, i, i // 500 + 1) for i in range(9000)), key=repr)
    mixed = small.unionByName(spark.range(9000).selectExpr("250L AS k", "id + 9000 AS n"))
    numbered = with_ordinal(mixed, ["k"], ["n"], parts=8, part_rows=10)
    assert "__part" in numbered._jdf.queryExecution().executedPlan().toString()
    got = [(r.n, r.ordinal) for r in numbered.where("k = 250").collect()]
    assert sorted(got) == [(n, place) for place, n in enumerate([*range(250, 9000, 500), *range(9000, 18000)], 1)]


def test_paginate(skewed):
    rows, df = skewed
    got = {(r["k"], r["n"]): (r["page_no"], r["position"]) for r in paginate(df, "k", ["n"], 7).collect()}
    assert got == {
        (key, row[1]): divmod(i, 7) for key, group in by_key(rows).items() for i, row in enumerate(group)
    }


def test_rolling_series(skewed):
    _, df = skewed
    got = {r["n"]: r["series"] for r in rolling_series(df, ["n"], 400).collect()}
    assert got == {i: i // 400 for i in range(9000)}


def averager(values, size=10):
    """Means over a ring that starts filled with the first value."""
    ring, out = [values[0]] * size, []
    for i, value in enumerate(values):
        ring[i % size] = value
        out.append(sum(ring) / size)
    return out


def test_warm_start_fixture(spark):
    df = spark.createDataFrame([("s", i, i) for i in range(1, 13)], "s string, i int, v int")
    got = warm_start_moving_avg(df, ["s"], ["i"], "v").orderBy("i").collect()
    want = [1.0, 1.1, 1.3, 1.6, 2.0, 2.5, 3.1, 3.8, 4.6, 5.5, 6.5, 7.5]
    assert [r["moving_avg"] for r in got] == want


@pytest.mark.parametrize("chunk", [1, 13, 100, 10_000])
def test_moving_average_over_chunks(spark, chunk):
    draw = random.Random(3)
    series = {"hot": 700, "mid": 25, "one": 1}
    values = {name: [draw.randrange(1000) for _ in range(n)] for name, n in series.items()}
    rows = [(name, i, v) for name, all_ in values.items() for i, v in enumerate(all_)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, i int, v int")
    got = {(r["s"], r["i"]): r["moving_avg"] for r in warm_start_moving_avg(df, ["s"], ["i"], "v", chunk_rows=chunk).collect()}
    want = {(name, i): m for name, all_ in values.items() for i, m in enumerate(averager(all_))}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


ROSTER = "ExternalDirectoryObjectId string, DisplayName string, PrimarySmtpAddress string"


def test_upsert(spark):
    target = spark.createDataFrame([("1", "A", "a"), ("2", "B", "b")], ROSTER)
    source = spark.createDataFrame(
        [("1", None, "x", "f1", 0), ("3", "old", None, "f1", 0), ("3", "new", None, "f2", 0), ("3", "mid", None, "f1", 5)],
        ROSTER + ", file string, pos int",
    )
    keys, order = ["ExternalDirectoryObjectId"], ["file", "pos"]
    once = merge.merge_upsert(target, source, keys, order)
    want = [("1", None, "x"), ("2", "B", "b"), ("3", "new", None)]
    assert tuples(once) == want
    assert tuples(merge.merge_upsert(once, source, keys, order)) == want
    shuffled = source.repartition(7, "pos")
    assert tuples(merge.merge_upsert(target, shuffled, keys, order)) == want


def test_upsert_with_collation(spark):
    target = spark.createDataFrame([("a", "A", None)], ROSTER)
    source = spark.createDataFrame([("A", "B", None, 1), ("a", "C", None, 2), ("b", "D", None, 1)], ROSTER + ", pos int")
    keys = ["ExternalDirectoryObjectId"]
    got = merge.merge_upsert(target, source, keys, ["pos"], "UTF8_LCASE")
    assert tuples(got) == [("a", "C", None), ("b", "D", None)]
    assert len(tuples(merge.merge_upsert(target, source, keys, ["pos"]))) == 3


def test_insert_only(spark):
    target = spark.createDataFrame([("u", 1, "old")], "m string, k long, v string")
    source = spark.createDataFrame(
        [("u", 1, "newer", 0), ("u", 2, "second", 9), ("u", 2, "first", 1), ("v", 1, "v", 0)],
        "m string, k long, v string, pos int",
    )
    new = merge.merge_insert_only(target, source, ["m", "k"], ["pos"])
    assert tuples(new) == [("u", 2, "first"), ("v", 1, "v")]
    after = target.unionByName(new)
    assert merge.merge_insert_only(after, source, ["m", "k"], ["pos"]).isEmpty()
    folded = merge.merge_insert_only(
        target.withColumn("m", F.upper("m")), source, ["m", "k"], ["pos"], "UTF8_LCASE"
    )
    assert tuples(folded) == [("u", 2, "first"), ("v", 1, "v")]


def test_dml(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    changes = spark.createDataFrame([(2, None, "z", 1), (9, "n", "n", 1), (2, "older", "o", 0)], "k int, v string, w string, pos int")
    assert tuples(merge.dml_update_by_key(target, changes, ["k"], ["pos"])) == [(1, "a", "x"), (2, None, "z")]
    gone = spark.createDataFrame([(2,), (7,)], "k int")
    assert tuples(merge.dml_delete_by_key(target, gone, ["k"])) == [(1, "a", "x")]
    assert merge.dml_append(target, target).count() == 4


def test_worklist(spark):
    roster = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "ExternalDirectoryObjectId string")
    progress = spark.createDataFrame(
        [("user", "1"), ("user", "1"), ("other", "2"), ("user", "9")], "type string, value string"
    )
    todo = W.resume_worklist(roster, progress)
    assert tuples(todo) == [("2",), ("3",), ("4",)]
    assert W.pending_count(roster, progress).first()["pending"] == 3
    assert tuple(W.progress_ratio(roster, progress).first()) == (0.25, 1, 4)
    commit = W.progress_commit(progress, roster.unionByName(roster), "ExternalDirectoryObjectId")
    assert tuples(commit) == [("user", "2"), ("user", "3"), ("user", "4")]
    done = progress.unionByName(commit)
    assert W.resume_worklist(roster, done).isEmpty()
    assert W.progress_commit(done, roster, "ExternalDirectoryObjectId").isEmpty()


def test_window_and_validation(spark):
    times = ["2024-01-01", "2024-01-02", "2024-01-03", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp"))
    inside = filters.time_window_filter(df, "t", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))
    assert [r["t"] for r in inside.collect()] == [dt.datetime(2024, 1, 2)]
    rows = spark.createDataFrame(
        [("u", "", ""), (None, "c", "1"), ("", "c", "1"), ("u", None, "1"), ("u", "c", None)],
        "mailbox string, chat string, id string",
    )
    judged = filters.validate_messages(rows, "mailbox", "chat", "id")
    assert [r["problem"] for r in judged.collect()] == [None, "mailbox", "mailbox", "chatId", "id"]
    with pytest.raises(PySparkException, match="missing"):
        filters.require_valid(judged).collect()
    assert filters.require_valid(judged.where("problem IS NULL")).columns == rows.columns
    assert filters.filter_null_or_empty(rows, "mailbox").count() == 3


def test_selections(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert tuples(filters.find_all(df)) == [(1, "a"), (2, "b"), (3, "c")]
    assert tuples(filters.find_all(df, F.col("k") > 1, "v")) == [("b",), ("c",)]
    assert tuples(filters.find_first(df, ["k"])) == [(1, "a")]
    assert tuples(filters.find_first(df, ["k"], F.col("k") > 1, "v")) == [("b",)]
    assert filters.find_first(df, ["k"], F.col("k") > 9).isEmpty()
    keys = spark.createDataFrame([(3, "c"), (3, "c"), (1, "z")], "k int, v string")
    assert tuples(filters.lookup_by_keys(df, keys, ["k", "v"])) == [(3, "c")]


def test_sql_text(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    rows = parametrized_sql(spark, "SELECT k FROM {df} WHERE k > :low", {"low": 1}, df=df)
    assert tuples(rows) == [(2,)]
    assert scalar_int(rows).first()["value"] == 2
    assert scalar_int(rows.where("k > 5")).first()["value"] == 0
    assert scalar_datetime(rows.where("k > 5")).first()["value"] is None
    quoted = parametrized_sql(spark, "SELECT :v AS v", {"v": "x' OR '1'='1"})
    assert quoted.first()["v"] == "x' OR '1'='1"


def test_concat(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", "z")], "g string, v string")
    assert tuples(string_concat_agg(df, ["g"], "v")) == [("a", "x;x;y"), ("b", "z")]


def test_rates_and_reports(spark):
    log = spark.createDataFrame(
        [("r", dt.datetime(2024, 1, 1, 0, 0, s), "page", f"u{s % 2}", s, 10, 5, None) for s in range(0, 30, 3)],
        metrics.RUN_LOG,
    )
    rates = metrics.rate_per_window(log, "ts", "10 seconds", amount=F.col("items")).orderBy("window_start")
    assert [(r["items"], r["per_second"]) for r in rates.collect()] == [(18, 1.8), (45, 4.5), (72, 7.2)]
    elapsed = metrics.elapsed_per_user(log, "mailbox", "ts")
    assert tuples(elapsed) == [("u0", 24000), ("u1", 24000)]
    summary = metrics.run_summary(log).first()
    assert (summary["items"], summary["elapsed_ms"], summary["items_per_second"]) == (135, 27000, 5.0)
    assert tuples(metrics.run_totals(log)) == [("page", 10, 135, 100, 50)]
    empty = metrics.run_summary(log.where("items < 0")).first()
    assert (empty["items"], empty["items_per_second"]) == (0, None)
    single = metrics.run_summary(log.limit(1)).first()
    assert single["items_per_second"] is None


def test_run_log_rolls(spark, tmp_path):
    log = spark.range(95).selectExpr("id AS items").coalesce(1)
    path = str(tmp_path / "log")
    metrics.append_run_log(log, path, 10)
    metrics.append_run_log(log, path, 10)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert sum(r["count"] for r in files) == 190 and max(r["count"] for r in files) == 10


def test_messages_per_page(spark, pages):
    frame = pages.frame(
        spark,
        [
            pages.page("u", 0, [pages.message("1"), pages.message("2")], more=True),
            pages.page("u", 1, []),
            pages.page("v", 0, status=403),
        ],
    )
    assert tuples(metrics.messages_per_page(frame)) == [("u", 0, 2), ("u", 1, 0), ("v", 0, 0)]
    assert tuples(metrics.messages_per_user(frame)) == [("u", 2, 2), ("v", 0, 1)]


def test_id_collisions(spark):
    df = spark.createDataFrame(
        [("u", "c", "x"), ("u", "c", "y"), ("u", "c", "1"), ("u", "d", "x")], "m string, c string, i string"
    )
    assert tuples(metrics.id_collisions(df, "m", "c", "i")) == [("u", "c", 2, 1)]
