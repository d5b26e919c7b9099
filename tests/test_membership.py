"""Merges that read only the buckets that a batch may touch."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from threadhaul import schemas as S
from threadhaul.operators.concat import string_concat_agg
from threadhaul.operators.membership import Membership, bucket_number, bucket_of_file, known_keys
from threadhaul.runtime import stored as kept
from threadhaul.tables import ChatStore

KEYS = tuple(S.MESSAGE_KEY)


def messages(spark, rows):
    """Messages of (mailbox, chat, id, value), in the order given."""
    frame = spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], "mailbox string, chatId string, idKey int, rawJson string, position int")
    missing = [f for f in S.MESSAGE.fields if f.name not in frame.columns]
    frame = frame.withColumns({f.name: F.lit(None).cast(f.dataType.simpleString().replace("varchar", "varchar")) for f in missing})
    return frame.withColumns({"slice": F.lit(0), "chain_pos": F.lit(0)})


def stored(store):
    return sorted((r.mailbox, r.chatId, r.idKey, r.rawJson) for r in store.read(S.MESSAGE_TABLE).collect())


@pytest.fixture
def bucketed(spark, settings):
    store = ChatStore(spark, dataclasses.replace(settings, buckets=16))
    store.ensure_tables()
    return store


def files_read(df):
    """Files and rows that the scans of a finished query have read."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            found.append(tuple(metrics.get(name).get().value() for name in ("numFiles", "numOutputRows")))
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    walk(plan.executedPlan())
    return found


def test_merges_equal_a_plain_dictionary(spark, bucketed):
    import random

    rng, want = random.Random(2), {}
    for batch in range(4):
        rows = [(f"u{rng.randrange(5)}", f"c{rng.randrange(4)}", rng.randrange(40 * (batch + 1)), f"{batch}.{n}") for n in range(300)]
        before = len(want)
        for mailbox, chat, number, value in rows:
            want.setdefault((mailbox, chat, number), value)
        assert bucketed.merge_messages(messages(spark, rows)) == len(want) - before
        assert stored(bucketed) == sorted((*key, value) for key, value in want.items())
    assert bucketed.merge_messages(messages(spark, rows)) == 0
    assert bucketed.merge_messages(messages(spark, rows).limit(0)) == 0


def test_a_batch_of_one_bucket_reads_one_bucket(spark, bucketed, tmp_path):
    rows = [(f"u{n % 7}", "c", n, "old") for n in range(2000)]
    bucketed.merge_messages(messages(spark, rows))
    keys = messages(spark, rows).withColumn("idKey", F.col("idKey").cast("bigint"))
    number = keys.withColumn("b", bucket_number(KEYS, 16)).where("b = 5")
    batch = number.drop("b").limit(20)
    index = bucketed.membership()
    maybe = kept(index.may_hold(index.placed(batch.select(*KEYS))), str(tmp_path / "maybe"))
    assert maybe.count() == 20 and {r.bucket for r in maybe.collect()} == {5}
    table = bucketed.read(S.MESSAGE_TABLE)
    assert {r.b for r in table.where(bucket_of_file() == 5).select(bucket_number(KEYS, 16).alias("b")).distinct().collect()} == {5}
    known = known_keys(table, maybe, KEYS)
    assert "ReadSchema: struct<mailbox:string,chatId:string,idKey:bigint>" in known._jdf.queryExecution().toString()
    in_bucket = table.where(bucket_number(KEYS, 16) == 5).count()
    assert (1, in_bucket) in files_read(known) and in_bucket < 400
    assert all(files == 1 for files, _ in files_read(known))
    # Buckets without a row of the batch are not read for the filter either.
    assert known.count() == 20


def test_strange_keys_are_settled_exactly(spark, bucketed, tmp_path):
    """With one block a bucket, some sixteen keys fill it and one strange key in six looks known: what is stored is the same."""
    rows = [(f"u{n % 3}", "c", n, "x") for n in range(500)]
    bucketed.merge_messages(messages(spark, rows[:250]))
    name, place = bucketed.name(S.MESSAGE_TABLE), str(tmp_path / "crowded")
    crowded = Membership(spark, place, KEYS, 16, blocks=1)
    crowded.create()
    crowded.add(crowded.placed(bucketed.read(S.MESSAGE_TABLE).select(*KEYS)))
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('membership_location' = '{place}', 'membership_blocks' = '1')")
    assert bucketed.membership().may_hold(crowded.placed(messages(spark, rows[250:]).select("mailbox", "chatId", F.col("idKey").cast("long").alias("idKey")))).count() > 20
    assert bucketed.merge_messages(messages(spark, rows)) == 250
    assert stored(bucketed) == sorted(rows)


def test_few_strange_keys_look_known(spark, tmp_path):
    filter_ = Membership(spark, str(tmp_path / "m"), ("k",), 8, blocks=128)
    filter_.create()
    keys = spark.range(8 * 128 * 8).select(F.col("id").alias("k"))
    filter_.add(filter_.placed(keys))
    assert filter_.may_hold(filter_.placed(keys)).count() == keys.count()
    others = spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("k"))
    assert filter_.may_hold(filter_.placed(others)).count() < 0.06 * 20_000


def test_a_crash_before_the_rows_loses_nothing(spark, bucketed, monkeypatch):
    """The filter knows keys before the table has them: they are looked up, not found, and stored."""
    rows = [(f"u{n % 3}", "c", n, "x") for n in range(60)]
    monkeypatch.setattr(ChatStore, "_insert", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        bucketed.merge_messages(messages(spark, rows))
    monkeypatch.undo()
    assert stored(bucketed) == []
    assert bucketed.merge_messages(messages(spark, rows)) == 60
    assert stored(bucketed) == sorted(rows)


def test_all_ways_into_the_table_are_learned(spark, bucketed):
    rows = [("u", "c", n, "x") for n in range(40)]
    bucketed.append(S.MESSAGE_TABLE, messages(spark, rows[:10]))
    assert bucketed.append_messages(messages(spark, rows[10:20])) == 10
    folded = ChatStore(spark, dataclasses.replace(bucketed.settings, key_collation="UTF8_LCASE"))
    assert folded.merge_messages(messages(spark, [("U", "C", n, "y") for n in range(15, 30)])) == 10
    bucketed.compact(S.MESSAGE_TABLE)
    assert bucketed.merge_messages(messages(spark, rows)) == 20
    assert len(stored(bucketed)) == 50
    bucketed.delete(S.MESSAGE_TABLE, messages(spark, rows[:5]).select(*KEYS), list(KEYS))
    assert bucketed.merge_messages(messages(spark, rows)) == 5
    place = bucketed.membership().place
    bucketed.reset_tables()
    import os

    assert not os.path.exists(place)


def test_tables_without_a_filter(spark, bucketed):
    spark.sql(f"ALTER TABLE {bucketed.name(S.MESSAGE_TABLE)} UNSET TBLPROPERTIES ('membership_location', 'membership_blocks')")
    rows = [("u", "c", n, "x") for n in range(10)]
    assert bucketed.merge_messages(messages(spark, rows[:6])) == 6
    bucketed.rebuild_membership()
    assert bucketed.membership() is not None
    assert bucketed.merge_messages(messages(spark, rows)) == 4
    assert stored(bucketed) == sorted(rows)


def test_concatenation_is_in_the_order_of_the_values(spark):
    rows = [(1, v) for v in ("a", "a", "a:", "b", "b", "b ", "a;", "az", None)]
    got = string_concat_agg(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").first().joined
    assert got == ";".join(sorted(v for _, v in rows if v))
