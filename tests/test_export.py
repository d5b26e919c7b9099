import dataclasses
import json
import math

import pytest
from pyspark.sql import functions as F

from threadhaul import schemas as S
from threadhaul.plans.export import (
    ChatExport,
    ExportFailed,
    landed_pages_reader,
    paged_source_reader,
)
from threadhaul.settings import SettingsError
from threadhaul.runtime import clear_scratch, scratch
from threadhaul.sources.paged import (
    PageResponse,
    deal_by_size,
    expected_sizes,
    register_paged_source,
    slice_window,
    write_worklist,
)
from threadhaul.streaming.pages import PageStreamExport, page_stream
from threadhaul.tables import SchemaVersionError


def land(spark, pages, tmp_path, rows, name="landing"):
    path = str(tmp_path / name)
    pages.frame(spark, rows).write.mode("append").parquet(path)
    return path


def stored(store):
    rows = store.read(S.MESSAGE_TABLE).select("mailbox", "chatId", "idKey", "lastModifiedDateTime")
    return sorted(tuple(map(str, r)) for r in rows.collect())


def keys(store):
    return [row[:3] for row in stored(store)]


def done(store):
    return sorted(r["value"] for r in store.read(S.PROGRESS_TABLE).collect())


def scenario(pages):
    m = pages.message
    return [
        pages.page("u1", 0, [m("1"), m("x"), m("y"), m("2", ts="2020-01-01T00:00:00Z")], more=True),
        pages.page("u1", 1, [m("1", ts="2024-06-01T00:00:00Z"), m("3")]),
        pages.page("u2", 0, [m("1")], more=True),
        pages.page("u2", 1, status=403),
        pages.page("u2", 2, [m("9")]),
        pages.page("u3", 0, status=402),
        pages.page("u3", 0, [], model="B"),
        pages.page("u4", 0, [m("1")], more=True),
        pages.page("u4", 1, status=500),
        pages.page("u5", 0, [m("1")], more=True),
        pages.page("u6", 0, body='{"value":3}'),
        pages.page("stranger", 0, [m("1")]),
    ]


WANT = [
    ("u1", "c", "0"), ("u1", "c", "1"), ("u1", "c", "3"), ("u2", "c", "1"), ("u4", "c", "1"), ("u5", "c", "1"),
]


def test_run_and_resume(spark, store, settings, pages, tmp_path, roster_folder):
    roster = roster_folder("u1", "u2", "u3", "u4", "u5", "u6", "u7", "")
    reader = landed_pages_reader(spark.read.parquet(land(spark, pages, tmp_path, scenario(pages))))
    report = ChatExport(spark, settings).run(roster, reader)
    assert keys(store) == WANT
    assert done(store) == ["u1", "u2", "u3"]
    assert (report.pending, report.inserted, report.finished, report.failed) == (7, 6, 3, 2)
    assert report.messages == 8 and report.pages == 11
    # The first version of a message stays although a newer one came later.
    assert [r[3] for r in stored(store) if r[:3] == ("u1", "c", "1")] == ["2024-05-01 10:00:00"]
    quarantine = spark.read.json(report.folder + "/quarantine").collect()
    assert json.loads(quarantine[0]["object"])["ExternalDirectoryObjectId"] == ""
    assert report.summary(spark).count() == 1

    before = stored(store)
    again = ChatExport(spark, settings).run(roster, reader)
    assert (again.pending, again.inserted) == (4, 0)
    assert stored(store) == before

    # The failed users' pages are fetched again, and now they end well.
    m = pages.message
    better = land(
        spark,
        pages,
        tmp_path,
        [pages.page(u, 0, [m("1"), m("5")]) for u in ("u4", "u5", "u6")] + [pages.page("u7", 0, [])],
        "better",
    )
    third = ChatExport(spark, settings).run(None, landed_pages_reader(spark.read.parquet(better)))
    assert (third.inserted, third.finished) == (4, 4)
    assert done(store) == [f"u{i}" for i in range(1, 8)]

    def never(worklist):
        raise AssertionError("nothing is pending, so nothing may be read")

    assert ChatExport(spark, settings).run(None, never).pending == 0


def test_wider_window_does_not_bring_finished_users_back(spark, store, settings, pages, tmp_path, roster_folder):
    roster = roster_folder("u1")
    reader = landed_pages_reader(
        pages.frame(spark, [pages.page("u1", 0, [pages.message("1", ts="2020-01-01T00:00:00Z")])])
    )
    assert ChatExport(spark, settings).run(roster, reader).finished == 1
    wider = dataclasses.replace(settings, start="2000-01-01Z")
    assert ChatExport(spark, wider).run(roster, reader).pending == 0
    assert keys(store) == []


def test_crash_between_messages_and_progress(spark, store, settings, pages, tmp_path, roster_folder, monkeypatch):
    roster = roster_folder("u1", "u2")
    reader = landed_pages_reader(spark.read.parquet(land(spark, pages, tmp_path, scenario(pages))))
    export = ChatExport(spark, settings)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(export.store, "commit_progress", crash)
    with pytest.raises(RuntimeError, match="lost"):
        export.run(roster, reader)
    assert done(store) == []
    after = stored(store)
    assert len(after) == 4
    report = ChatExport(spark, settings).run(roster, reader)
    assert report.inserted == 0 and stored(store) == after and done(store) == ["u1", "u2"]


def test_refused_messages(spark, store, settings, pages, tmp_path, roster_folder):
    m = pages.message
    rows = [
        pages.page("u1", 0, [m("1"), m(None), m("2", chat=None), m("", chat="")]),
        pages.page("u2", 0, [m("1")]),
    ]
    roster = roster_folder("u1", "u2")
    reader = landed_pages_reader(spark.read.parquet(land(spark, pages, tmp_path, rows)))
    report = ChatExport(spark, settings).run(roster, reader)
    assert report.refused == 2
    assert keys(store) == [("u1", "", "0"), ("u1", "c", "1"), ("u2", "c", "1")]
    assert done(store) == ["u2"]
    problems = spark.read.parquet(report.folder + "/group=0/refused").select("problem").collect()
    assert sorted(r["problem"] for r in problems) == ["chatId", "id"]
    with pytest.raises(ExportFailed):
        ChatExport(spark, dataclasses.replace(settings, strict=True)).run(roster, reader)


def test_too_long_values_are_refused(spark, store, settings, pages, tmp_path, roster_folder):
    rows = [pages.page("u1", 0, [pages.message("1", chat="c" * 201)]), pages.page("u2", 0, [pages.message("1", chat="c" * 200)])]
    reader = landed_pages_reader(spark.read.parquet(land(spark, pages, tmp_path, rows)))
    report = ChatExport(spark, settings).run(roster_folder("u1", "u2"), reader)
    assert keys(store) == [("u2", "c" * 200, "1")] and done(store) == ["u2"]
    problems = spark.read.parquet(report.folder + "/group=0/refused").select("problem").collect()
    assert [r["problem"] for r in problems] == ["chatId is longer than 200"]


def test_a_failed_attempt_does_not_bind_the_next(spark, store, settings, pages, roster_folder):
    m = pages.message
    first = [pages.page("u", 0, [m("1")], more=True), pages.page("u", 1, status=500)]
    second = [pages.page("u", n, [m(str(n + 1))], more=n < 3) for n in range(4)]
    landed = lambda rows, attempt: pages.frame(spark, rows).withColumn("attempt", F.lit(attempt))
    roster = roster_folder("u")
    report = ChatExport(spark, settings).run(roster, landed_pages_reader(landed(first, 0)))
    assert (report.failed, report.finished) == (1, 0) and keys(store) == [("u", "c", "1")]
    both = landed(first, 0).unionByName(landed(second, 1))
    report = ChatExport(spark, settings).run(roster, landed_pages_reader(both))
    assert (report.failed, report.finished, report.inserted) == (0, 1, 3)
    assert [k[2] for k in keys(store)] == ["1", "2", "3", "4"] and done(store) == ["u"]


def test_gaps_leave_a_chain_open(spark, store, settings, pages, roster_folder):
    m = pages.message
    rows = [pages.page("u", 0, [m("1")], more=True), pages.page("u", 2, [m("3")])]
    roster = roster_folder("u")
    report = ChatExport(spark, settings).run(roster, landed_pages_reader(pages.frame(spark, rows)))
    assert (report.finished, report.failed) == (0, 0) and done(store) == []
    rows.append(pages.page("u", 1, [m("2")], more=True))
    report = ChatExport(spark, settings).run(roster, landed_pages_reader(pages.frame(spark, rows)))
    assert report.finished == 1 and [k[2] for k in keys(store)] == ["1", "2", "3"]


def counting_fetcher(folder, broken):
    """A fetcher that raises for some users, and notes in files whom it was asked for."""

    class Counting:
        def fetch(self, request):
            import uuid
            from pathlib import Path

            Path(folder, f"{request.mailbox}-{uuid.uuid4().hex}").touch()
            if request.mailbox in broken:
                raise OSError("connection reset")
            time = "2024-05-01T10:00:00Z"
            message = {"id": "1", "chatId": "c", "createdDateTime": time, "lastModifiedDateTime": time}
            return PageResponse(200, json.dumps({"value": [message]}))

    return Counting()


def test_groups_survive_failures_and_restarts(spark, store, settings, tmp_path, roster_folder, monkeypatch):
    asked = tmp_path / "asked"
    asked.mkdir()
    users = [f"u{n}" for n in range(20)]
    source = register_paged_source(spark, counting_fetcher(str(asked), {"u7"}), "counting")
    grouped = dataclasses.replace(settings, groups=3)
    reader = paged_source_reader(spark, source, grouped, groups=2)
    export = ChatExport(spark, grouped)
    merge, calls = export.store.merge_messages, []

    def killed(rows):
        if calls:
            raise RuntimeError("killed")
        calls.append(merge(rows))
        return calls[-1]

    monkeypatch.setattr(export.store, "merge_messages", killed)
    with pytest.raises(RuntimeError, match="killed"):
        export.run(roster_folder(*users), reader)
    first = done(store)
    assert 0 < len(first) < 19
    report = ChatExport(spark, grouped).run(None, reader)
    assert (report.failed, report.pending) == (1, 20 - len(first))
    assert sorted(done(store)) == sorted(set(users) - {"u7"}) and len(keys(store)) == 19
    times = [p.name.split("-")[0] for p in asked.iterdir()]
    assert all(times.count(user) == 1 for user in first)
    users_log = spark.read.parquet(report.folder + "/log").where("event = 'user'")
    assert users_log.count() == 2 * report.pending
    summary = report.summary(spark).first()
    assert summary["items"] == report.messages and summary["elapsed_ms"] > 0


def test_other_sessions_are_seen(spark, store, settings, pages, roster_folder):
    """Two sessions store the same messages: each key is there once."""
    from threadhaul.tables import ChatStore

    rows = [pages.page("u1", 0, [pages.message("1")])]
    other = spark.newSession()
    reader = landed_pages_reader(pages.frame(spark, rows))
    assert store.read(S.MESSAGE_TABLE).count() == 0 and ChatStore(other, settings).read(S.MESSAGE_TABLE).count() == 0
    roster = roster_folder("u1")
    ChatExport(spark, settings).run(roster, reader)
    with_other = landed_pages_reader(other.createDataFrame(rows, S.LANDED_PAGE))
    report = ChatExport(other, settings).run(roster, with_other)
    assert (report.pending, report.inserted) == (0, 0)
    assert keys(store) == [("u1", "c", "1")] and done(store) == ["u1"]


def test_guards(spark, settings, tmp_path, roster_folder):
    def never(worklist):
        raise AssertionError

    with pytest.raises(SchemaVersionError):
        ChatExport(spark, settings).run(None, never)
    reset = dataclasses.replace(settings, reset=True, end="")
    with pytest.raises(SettingsError):
        ChatExport(spark, reset).run(None, never)


def test_tables(spark, store, settings, roster_folder):
    assert store.version() == "1.0" and store.check_version() == "1.0"
    store.set_version("0.9")
    with pytest.raises(SchemaVersionError, match="found 0.9"):
        store.check_version()
    store.delete_version()
    assert store.version() is None
    with pytest.raises(SchemaVersionError):
        store.check_version()
    store.delete_version()

    rows = spark.createDataFrame(
        [("A", "1", "a@x", "f", 0, 0)],
        "DisplayName string, ExternalDirectoryObjectId string, PrimarySmtpAddress string,"
        " file_path string, block_start long, position long",
    )
    for name in ("A", "B", "C", "D"):
        store.upsert_roster(rows.withColumn("DisplayName", F.lit(name)))
    assert [tuple(r) for r in store.read(S.ROSTER_TABLE).collect()] == [("D", "1", "a@x")]
    spark.sql(f"CREATE TABLE `{settings.database}`.mine (a int) USING parquet")
    store.reset_tables()
    left = {t.name for t in spark.catalog.listTables(settings.database)}
    assert left == {"mine"}
    store.ensure_tables()
    assert store.read(S.ROSTER_TABLE).isEmpty() and store.version() is None
    store.analyze(S.MESSAGE_TABLE)


def test_stored_changes(spark, store, settings, pages, tmp_path, roster_folder):
    """Append, update, delete and compaction, each on the stored tables."""
    rows = [pages.page("u", 0, [pages.message(str(n)) for n in range(5)])]
    ChatExport(spark, settings).run(roster_folder("u"), landed_pages_reader(pages.frame(spark, rows)))
    table = store.read(S.MESSAGE_TABLE)
    store.append(S.MESSAGE_TABLE, table.where("idKey = 4").withColumn("idKey", F.lit(9).cast("long")))
    assert [k[2] for k in keys(store)] == ["0", "1", "2", "3", "4", "9"]
    changes = store.read(S.MESSAGE_TABLE).where("idKey < 2").withColumn("rawJson", F.lit("new")).withColumn("n", F.lit(1))
    store.update(S.MESSAGE_TABLE, changes, S.MESSAGE_KEY, ["n"])
    assert store.read(S.MESSAGE_TABLE).where("rawJson = 'new'").count() == 2
    doomed = store.read(S.MESSAGE_TABLE).where("idKey IN (0, 9)")
    store.delete(S.MESSAGE_TABLE, doomed, S.MESSAGE_KEY)
    assert [k[2] for k in keys(store)] == ["1", "2", "3", "4"]
    before = store.version()
    for n in range(20, 28):
        store.append(S.MESSAGE_TABLE, store.read(S.MESSAGE_TABLE).where("idKey = 4").withColumn("idKey", F.lit(n).cast("long")))
    assert len(store.read(S.MESSAGE_TABLE).inputFiles()) > 8
    store.compact(S.MESSAGE_TABLE)
    assert len(store.read(S.MESSAGE_TABLE).inputFiles()) <= 4 and len(keys(store)) == 12
    assert store.version() == before
    # Still bucketed: a second run adds nothing.
    store.delete(S.PROGRESS_TABLE, store.read(S.PROGRESS_TABLE), S.PROGRESS_KEY)
    report = ChatExport(spark, settings).run(None, landed_pages_reader(pages.frame(spark, rows)))
    assert (report.pending, report.inserted) == (1, 1)


def test_old_roster_versions_are_removed(spark, store, settings, tmp_path):
    rows = spark.createDataFrame(
        [("A", "1", "a@x", "f", 0, 0)],
        "DisplayName string, ExternalDirectoryObjectId string, PrimarySmtpAddress string,"
        " file_path string, block_start long, position long",
    )
    reader = store.read(S.ROSTER_TABLE)
    store.upsert_roster(rows)
    assert reader.isEmpty()  # still sees the version it was planned on
    for _ in range(3):
        store.upsert_roster(rows)
    versions = [p.name for p in (tmp_path / "database").iterdir() if p.name.startswith(S.ROSTER_TABLE)]
    assert len(versions) == 2


def load_roster(spark, settings, *users):
    rows = [(None, user, None, "f", 0, n) for n, user in enumerate(users)]
    kinds = "DisplayName string, ExternalDirectoryObjectId string, PrimarySmtpAddress string, file_path string, block_start long, position long"
    ChatExport(spark, settings).store.upsert_roster(spark.createDataFrame(rows, kinds))


def test_stream_equals_batch(spark, store, settings, pages, tmp_path, roster_folder):
    load_roster(spark, settings, *{row[0] for row in scenario(pages)[:-1]})
    landing = land(spark, pages, tmp_path, scenario(pages)[:-1])
    stream = page_stream(spark, landing)
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    export.run(stream)
    assert keys(store) == WANT
    assert done(store) == ["u1", "u2", "u3"]
    before = stored(store)
    export.run(page_stream(spark, landing))  # nothing new
    PageStreamExport(spark, settings, str(tmp_path / "other")).run(page_stream(spark, landing))  # replay
    assert stored(store) == before and done(store) == ["u1", "u2", "u3"]


def test_stream_deals_the_pages_of_a_file_to_all_tasks(spark, store, settings, pages, tmp_path, monkeypatch):
    from threadhaul.streaming import pages as module

    store.upsert_roster(spark.createDataFrame([("u1", "f", 0, 0)], "ExternalDirectoryObjectId string, file_path string, block_start int, position int")
        .selectExpr("CAST(NULL AS STRING) AS DisplayName", "ExternalDirectoryObjectId", "CAST(NULL AS STRING) AS PrimarySmtpAddress", "file_path", "block_start", "position"))
    landing, plans = str(tmp_path / "landing"), []
    pages.frame(spark, [pages.page("u1", 0, [pages.message("1")])]).coalesce(1).write.parquet(landing)
    stage = module.stage_pages
    monkeypatch.setattr(module, "stage_pages", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, *a))
    PageStreamExport(spark, settings, str(tmp_path / "state")).run(page_stream(spark, landing))
    assert len(plans) == 1 and "REPARTITION_BY_COL" in plans[0]
    assert store.read("UserMessage").count() == 1


def test_stream_keeps_chain_ends_across_batches(spark, store, settings, pages, tmp_path):
    m = pages.message
    load_roster(spark, settings, "u")
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    for row in (
        pages.page("u", 0, [m("1")], more=True),
        pages.page("u", 1, status=403),
        pages.page("u", 2, [m("3")]),
    ):
        landing = land(spark, pages, tmp_path, [row])
        export.run(page_stream(spark, landing))
    assert keys(store) == [("u", "c", "1")] and done(store) == ["u"]


def test_stream_knows_strangers_refusals_and_order(spark, store, settings, pages, tmp_path, roster_folder):
    """What a batch run over the same pages stores and finishes."""
    m = pages.message
    rows = [
        pages.page("late", 1, [m("2")]),  # its first page comes later
        pages.page("bad", 0, [m(None)], more=True),
        pages.page("stranger", 0, [m("1")]),
        pages.page("bad", 1, [m("2")]),
        pages.page("late", 0, [m("1")], more=True),
        pages.page("open", 0, [m("1")], more=True),
    ]
    load_roster(spark, settings, "late", "bad", "open")
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    after = []
    for row in rows:
        export.run(page_stream(spark, land(spark, pages, tmp_path, [row])))
        after.append(done(store))
    assert after == [[], [], [], [], ["late"], ["late"]]
    streamed = keys(store)
    other = dataclasses.replace(settings, database=settings.database + "_b", database_location=str(tmp_path / "b"), reset=True)
    batch = ChatExport(spark, other)
    batch.run(roster_folder("late", "bad", "open"), landed_pages_reader(pages.frame(spark, rows)))
    assert keys(batch.store) == streamed and done(batch.store) == ["late"]
    assert not list((tmp_path / "state" / "staged").rglob("*.parquet"))


def test_stream_deletes_finished_files(spark, store, settings, pages, tmp_path):
    load_roster(spark, settings, "u0", "u1", "u2")
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    for number in range(3):
        landing = land(spark, pages, tmp_path, [pages.page(f"u{number}", 0, [pages.message("1")])])
        export.run(page_stream(spark, landing, delete=True))
    assert len(keys(store)) == 3
    assert len(list((tmp_path / "landing").rglob("*.parquet"))) < 3


def test_stream_archives_finished_files(spark, store, settings, pages, tmp_path):
    m = pages.message
    load_roster(spark, settings, "u0", "u1", "u2")
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    archive = str(tmp_path / "archive")
    for number in range(3):
        landing = land(spark, pages, tmp_path, [pages.page(f"u{number}", 0, [m("1")])])
        export.run(page_stream(spark, landing, archive=archive))
    archived = [p for p in (tmp_path / "archive").rglob("*.parquet")]
    assert archived and len(keys(store)) == 3


def answering(rows):
    """A service that has these pages, and applies the window of a request to their messages."""
    import datetime

    def instant(value):
        at = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)

    class Answering:
        def fetch(self, request):
            place = int(request.next_link.rsplit("#", 1)[1]) if request.next_link else 0
            found = [row for row in rows if (row[0], row[1], row[3]) == (request.mailbox, place, request.model)]
            if not found:
                return PageResponse(0) if place else PageResponse(200, '{"value": []}')
            _, _, status, _, link, body = found[0]
            try:
                page = json.loads(body)
                low, high = instant(request.start), instant(request.end)
                page["value"] = [x for x in page["value"] if low < instant(x["lastModifiedDateTime"]) < high]
                body = json.dumps(page)
            except (TypeError, KeyError, ValueError):
                pass  # handed on as it is
            return PageResponse(status, body, link)

    return Answering()


def test_export_through_the_paged_source(spark, store, settings, pages, roster_folder):
    source = register_paged_source(spark, answering(scenario(pages)), "paged_for_export")
    reader = paged_source_reader(spark, source, settings, groups=2)
    report = ChatExport(spark, settings).run(roster_folder("u1", "u2", "u3", "u4", "u6", "u7"), reader)
    assert keys(store) == [key for key in WANT if key[0] != "u5"]
    assert done(store) == ["u1", "u2", "u3", "u7"]
    assert report.failed == 2


def test_sliced_window(spark, store, settings, pages, roster_folder):
    """A mailbox fetched in slices gives the same messages, those on the bounds included."""
    m = pages.message
    bounds = ["2023-07-02T12:00:00Z", "2023-12-31T00:00:00Z", "2024-07-01T00:00:00Z"]
    times = bounds + ["2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z", "2023-01-01T00:00:01Z"]
    messages = [m(str(n), ts=ts) for n, ts in enumerate(times, 1)]
    rows = [pages.page("big", n, [one], more=n < 5) for n, one in enumerate(messages)]
    rows.append(pages.page("gone", 0, status=404))
    source = register_paged_source(spark, answering(rows), "paged_in_slices")
    cut = dataclasses.replace(settings, window_slices=7)
    report = ChatExport(spark, cut).run(
        roster_folder("big", "gone"), paged_source_reader(spark, source, cut, groups=3)
    )
    assert [row[2] for row in stored(store)] == ["1", "2", "3", "6"]
    assert report.pages == 7 * 6 + 7 and done(store) == ["big", "gone"]


def test_chains_are_dealt_by_the_sizes_of_earlier_runs(spark, store, settings, pages, tmp_path, roster_folder):
    """A mailbox with most of the messages is fetched by several tasks in the next run; all is stored once."""
    from pathlib import Path

    users = ["big", *(f"u{n}" for n in range(20))]
    counts = {user: 300 if user == "big" else n % 4 for n, user in enumerate(users)}
    rows = [
        pages.page(user, 0, [pages.message(str(i), ts=f"2024-{1 + i % 12:02}-{1 + i % 28:02}T10:00:00Z") for i in range(1, n + 1)])
        for user, n in counts.items()
    ]
    source = register_paged_source(spark, answering(rows), "paged_by_size")
    first = ChatExport(spark, settings).run(roster_folder(*users), paged_source_reader(spark, source, settings, groups=4))
    log = spark.read.parquet(first.folder + "/log")
    sized = {r.mailbox: r.size for r in expected_sizes(spark.createDataFrame([(u,) for u in [*users, "new"]], "mailbox string"), log).collect()}
    assert sized["big"] == 300 and sized["u2"] == 3 and sized["u3"] == 1 and sized["new"] == sum(counts.values()) / len(users)
    chains = deal_by_size(spark.createDataFrame(list(sized.items()), "mailbox string, size double"), 4).collect()
    loads = [sum(c.size for c in chains if c.task == task) for task in range(4)]
    assert max(loads) <= 4 / 3 * sum(loads) / 4 and min(loads) > 0
    assert {c.slices for c in chains if c.mailbox == "big"} == {math.ceil(300 * 12 / sum(sized.values()))}
    assert sorted(c.slice for c in chains if c.mailbox == "big") == list(range(len([c for c in chains if c.mailbox == "big"])))

    other = dataclasses.replace(settings, database=settings.database + "_b", database_location=str(tmp_path / "b"), reset=True)
    again = ChatExport(spark, other)
    report = again.run(roster_folder(*users), paged_source_reader(spark, source, other, groups=4, log=log))
    assert keys(again.store) == keys(store) and done(again.store) == sorted(users)
    assert report.inserted == first.inserted == sum(counts.values())
    write_worklist(spark.createDataFrame(list(sized.items()), "mailbox string, size double"), str(tmp_path / "w"), 4)
    assert len(list(Path(tmp_path / "w").glob("part-*.parquet"))) == 4


def test_stream_state_follows_the_open_chains(spark, store, settings, pages, tmp_path):
    """What is kept is of users still pending, in at most two versions."""
    m = pages.message
    load_roster(spark, settings, *(f"u{n}" for n in range(6)), "open", "bad")
    export = PageStreamExport(spark, settings, str(tmp_path / "state"))
    for n in range(6):
        rows = [pages.page(f"u{n}", 0, [m("1")]), pages.page("open", n, [m(str(n))], more=True)]
        rows += [pages.page("bad", 0, [m(None)], more=True)] if n == 0 else []
        export.run(page_stream(spark, land(spark, pages, tmp_path, rows)))
        kept = sorted(p.name for p in (tmp_path / "state" / "headers").iterdir())
        assert len(kept) <= 2 and kept[-1] == f"batch={n}"
        newest = spark.read.parquet(str(tmp_path / "state" / "headers" / f"batch={n}"))
        assert {r.mailbox for r in newest.collect()} == {"open", "bad"} and newest.count() == n + 2
    blamed = spark.read.parquet(str(tmp_path / "state" / "refused" / "batch=5"))
    assert [r.mailbox for r in blamed.collect()] == ["bad"]
    assert done(store) == [f"u{n}" for n in range(6)]
    export.run(page_stream(spark, land(spark, pages, tmp_path, [pages.page("open", 6, [m("6")]), pages.page("bad", 1, [m("2")])])))
    assert done(store) == sorted([*(f"u{n}" for n in range(6)), "open"])
    assert not (tmp_path / "state" / "work").exists() or not list((tmp_path / "state" / "work").iterdir())


def test_scratch_folders_can_be_removed(spark):
    from pathlib import Path

    path = scratch(spark, "short-lived")
    spark.range(3).write.parquet(path)
    assert Path(path).exists() and clear_scratch(spark) > 0
    assert not Path(path).exists() and clear_scratch(spark) == 0


def test_slices_cover_the_open_window():
    from datetime import datetime, timedelta

    start, end = datetime(2024, 1, 1), datetime(2024, 1, 8)
    tick = timedelta(microseconds=1)
    for slices in (1, 2, 3, 7, 11):
        parts = [slice_window(start, end, n, slices) for n in range(slices)]
        assert parts[0][0] == start and parts[-1][1] == end
        times = [edge + delta for part in parts for edge in part for delta in (-tick, 0 * tick, tick)]
        for ts in times:
            hits = sum(low < ts < high for low, high in parts)
            assert hits == (1 if start < ts < end else 0), (slices, ts)


def test_roster_from_line_files(spark, store, settings, pages, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = [json.dumps({"externaldirectoryobjectid": f"u{n}", "DisplayName": "x"}) for n in (1, 2, 1)]
    (folder / "AllMailBoxes1.json").write_text("\n".join(lines + ["{}"]))
    by_line = dataclasses.replace(settings, roster_lines=True)
    reader = landed_pages_reader(pages.frame(spark, [pages.page("u1", 0, [])]))
    report = ChatExport(spark, by_line).run(str(folder), reader)
    assert (report.pending, report.finished) == (2, 1)
    assert spark.read.json(report.folder + "/quarantine").count() == 1


def test_run_log(spark, store, settings, pages, tmp_path, roster_folder):
    reader = landed_pages_reader(pages.frame(spark, scenario(pages)))
    report = ChatExport(spark, settings).run(roster_folder("u1", "u2", "u4"), reader)
    log = spark.read.parquet(report.folder + "/log")
    notes = {r["mailbox"]: r["note"] for r in log.where("event = 'user'").collect()}
    assert notes == {
        "u1": "6 messages, complete",
        "u2": "2 messages, skipped",
        "u4": "1 messages, failed",
    }
    assert report.bytes_read > 0 and report.bytes_written > 0
    summary = report.summary(spark).first()
    assert summary["bytes_written"] == report.bytes_written and summary["elapsed_ms"] > 0


def test_paged_source_predicates(spark, pages, tmp_path):
    from threadhaul.sources.paged import write_worklist

    source = register_paged_source(spark, answering(scenario(pages)), "paged_predicates")
    worklist = str(tmp_path / "worklist")
    write_worklist(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "mailbox string"), worklist, 2)
    unbounded = spark.read.format(source).option("worklist", worklist).load()
    with pytest.raises(Exception, match="window"):
        unbounded.collect()
    bounded = spark.read.format(source).options(
        worklist=worklist, start="2023-01-01T00:00:00", end="2025-01-01T00:00:00"
    ).load()
    got = bounded.where("mailbox = 'u2'").orderBy("page_no")
    assert [(r["page_no"], r["status"]) for r in got.collect()] == [(0, 200), (1, 403)]
    assert bounded.where("mailbox IN ('u1', 'u3') AND status = 200").count() == 3
    early = bounded.where("window_end = timestamp '2021-01-01' AND window_start = timestamp '2019-01-01'")
    bodies = [json.loads(r["body"])["value"] for r in early.where("mailbox = 'u1'").orderBy("page_no").collect()]
    assert [[m["id"] for m in page] for page in bodies] == [["2"], []]


def test_store_collation(spark, settings, pages, tmp_path, roster_folder):
    folded = dataclasses.replace(settings, key_collation="UTF8_LCASE", reset=True)
    m = pages.message
    rows = [pages.page("u1", 0, [m("1", chat="C"), m("1", chat="c")])]
    reader = landed_pages_reader(spark.read.parquet(land(spark, pages, tmp_path, rows)))
    assert ChatExport(spark, folded).run(roster_folder("u1"), reader).inserted == 1
