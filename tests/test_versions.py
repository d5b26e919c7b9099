"""Several writers on one table, and writers that stop between any two steps."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from test_membership import messages, stored

from threadhaul import schemas as S
from threadhaul.tables import ChatStore
from threadhaul.versions import Version, VersionLog, WriteConflict

ROSTER = "DisplayName string, ExternalDirectoryObjectId string, PrimarySmtpAddress string, file_path string, block_start long, position long"


def roster(spark, **names):
    return spark.createDataFrame([(name, key, None, "f", 0, n) for n, (key, name) in enumerate(names.items())], ROSTER)


def names(store):
    return {r.ExternalDirectoryObjectId: r.DisplayName for r in store.read(S.ROSTER_TABLE).collect()}


@pytest.fixture
def stores(spark, settings):
    one = ChatStore(spark, dataclasses.replace(settings, buckets=4))
    one.ensure_tables()
    return one, ChatStore(spark, one.settings)


def test_a_number_is_committed_once(spark, tmp_path):
    one, other = (VersionLog(spark, str(tmp_path / "log")) for _ in range(2))
    assert one.latest() is None
    assert one.commit(Version(0, "a")) and not other.commit(Version(0, "b"))
    assert other.latest() == Version(0, "a")
    for n in range(1, 30):
        assert (one, other)[n % 2].commit(Version(n, f"x{n}", f"x{n - 1}"))
    assert one.latest() == other.latest() == Version(29, "x29", "x28")
    assert len(list((tmp_path / "log").glob("[0-9]*.json"))) == 10


def test_two_upserts_lose_nothing(spark, stores, monkeypatch):
    one, other = stores
    one.upsert_roster(roster(spark, a="1", b="1"))
    switch, interfered = ChatStore._switch, []

    def interrupted(self, table, make):
        def slow(old):
            if self is one and len(interfered) < 2:
                interfered.append(1)
                switch(other, table, lambda rows: rows.withColumn("DisplayName", F.concat("DisplayName", F.lit("+"))))
            return make(old)

        switch(self, table, slow)

    monkeypatch.setattr(ChatStore, "_switch", interrupted)
    one.upsert_roster(roster(spark, b="2", c="2"))
    assert names(one) == names(other) == {"a": "1++", "b": "2", "c": "2"}


def test_a_writer_that_is_always_second_gives_up(spark, stores):
    one, other = stores

    def make(old):
        other._switch(S.ROSTER_TABLE, lambda rows: rows)
        return old

    with pytest.raises(WriteConflict):
        one._switch(S.ROSTER_TABLE, make)


@pytest.mark.parametrize("step", ("write", "commit", "catalog", "cleanup"))
def test_a_writer_stops_between_two_steps(spark, stores, monkeypatch, step):
    one, other = stores
    for n in range(3):
        one.upsert_roster(roster(spark, a=str(n)))
    target, name = {
        "write": (ChatStore, "_create"),
        "commit": (VersionLog, "commit"),
        "catalog": (ChatStore, "read"),
        "cleanup": (ChatStore, "drop_folder"),
    }[step]
    right, calls = getattr(target, name), []

    def killed(*given):
        calls.append(1)
        # The second read of a switch comes behind its commit.
        if step != "catalog" or len(calls) == 2:
            raise RuntimeError("killed")
        return right(*given)

    monkeypatch.setattr(target, name, killed)
    with pytest.raises(RuntimeError, match="killed"):
        one.upsert_roster(roster(spark, a="new"))
    monkeypatch.undo()
    assert names(other) == {"a": "new" if step in ("catalog", "cleanup") else "2"}
    other.upsert_roster(roster(spark, b="later"))
    assert names(one)["b"] == "later" and names(one).keys() == {"a", "b"}


def test_merges_and_rewritings_at_once(spark, stores, monkeypatch):
    """Rows merged while the table is compacted are merged again if they landed in the folder that was left."""
    one, other = stores
    rows = [("u", "c", n, "x") for n in range(30)]
    one.merge_messages(messages(spark, rows[:10]))
    insert, done = ChatStore._insert, []

    def late(self, new):
        count = insert(self, new)
        if not done:
            done.append(1)
            # What has been written so far is not in the new folder: it was listed before.
            other.delete(S.MESSAGE_TABLE, messages(spark, rows[10:]).select(*S.MESSAGE_KEY), S.MESSAGE_KEY)
        return count

    monkeypatch.setattr(ChatStore, "_insert", late)
    assert one.merge_messages(messages(spark, rows)) == 20
    assert stored(one) == stored(other) == sorted(rows)


def test_a_rewriting_sees_rows_that_came_meanwhile(spark, stores):
    one, other = stores
    rows = [("u", "c", n, "x") for n in range(30)]
    one.merge_messages(messages(spark, rows[:10]))
    came = []

    def make(old):
        if not came:
            came.append(other.merge_messages(messages(spark, rows[5:20])))
        return old

    one._switch(S.MESSAGE_TABLE, make)
    assert came == [10] and stored(one) == stored(other) == sorted(rows[:20])


def test_plain_rows_are_never_added_twice(spark, stores, monkeypatch):
    one, other = stores
    rows = [("u", "c", n, "x") for n in range(5)]
    learn = ChatStore._learn
    settled, calls = ChatStore._settled, []

    def moved(self, table):
        found = settled(self, table)
        if self is one and not calls:
            calls.append(1)
            other._switch(table, lambda old: old)
        return found

    monkeypatch.setattr(ChatStore, "_settled", moved)
    with pytest.raises(WriteConflict, match="rewritten"):
        one.append(S.MESSAGE_TABLE, messages(spark, rows))
    monkeypatch.undo()
    assert learn and len(stored(other)) <= len(rows)
