"""Plans are what they should be: pruned, pushed down, pre-aggregated, and free of Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from threadhaul import schemas as S
from threadhaul.operators import filters
from threadhaul.operators import worklist as W
from threadhaul.operators.dedupe import dedupe_first_wins
from threadhaul.plans.messages import normalize_messages
from threadhaul.queries import QUERIES
from threadhaul.queries.derived import payloads
from threadhaul.queries.registry import Tables

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def test_worklist_is_an_anti_join_with_a_pushed_filter(spark, store):
    text = plan(W.resume_worklist(store.read(S.ROSTER_TABLE), store.read(S.PROGRESS_TABLE)))
    assert "LeftAnti" in text and "EqualTo(type,user)" in text
    assert "LeftOuter" not in text


def test_dedupe_limits_groups_before_the_shuffle(spark):
    text = plan(dedupe_first_wins(events(spark), ["user_id"], ["ts"]))
    partial = text.index("row_number(), 1, Partial")
    assert text.index("Exchange hashpartitioning(user_id") < partial  # below it in the tree
    assert text.count("Exchange") == 1


def test_window_reaches_the_scan(spark):
    df = filters.time_window_filter(
        events(spark),
        "ts",
        F.lit("2024-01-05").cast("timestamp_ntz"),
        F.lit("2024-01-09").cast("timestamp_ntz"),
    )
    text = plan(df.select("event_id"))
    assert "GreaterThan(ts,2024-01-05" in text and "LessThan(ts,2024-01-09" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_message_merge_reads_the_bucketed_keys_in_place(spark, store):
    messages = normalize_messages(payloads(Tables(spark, DATA)), "event_id")
    source = messages.withColumns(
        {"slice": F.lit(0), "chain_pos": F.lit(0), "position": F.col("event_id")}
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(store.messages_to_insert(source))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in text and "Bucketed: true" in text
    assert "ReadSchema: struct<mailbox:string,chatId:string,idKey:bigint>" in text
    # Only the source is shuffled, and only once.
    assert len(re.findall(r"Exchange hashpartitioning\(mailbox", text)) == 1


WRITERS = {
    "export_run",
    "export_resume",
    "stream_insert_only",
    "stream_pages",
    "rate_stream_per_window",
    "ensure_tables",
    "reset_tables",
    "schema_version_check",
    "analyze_table",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_python_and_no_pairing_of_everything(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    # Where an interval closes depends on all closes before: SQL functions have no form for that.
    in_arrow = "" if name == "sampled_rate" else "|MapInArrow"
    assert not re.search(rf"CartesianProduct|NestedLoop|EvalPython|InPandas|PythonUDF{in_arrow}", text)


def test_attachment_contents_are_parsed_once(spark, pages):
    """For the raw JSON and for the count of unusable links together."""
    from threadhaul.plans.messages import checked_messages
    from threadhaul.sources.pages import explode_pages

    snippet = {"contentType": "application/vnd.microsoft.card.codesnippet", "contentUrl": "stored"}
    contents = ['{"codeSnippetUrl":"u"}', '{"codeSnippetUrl":1}', "[1]", "no json", "", None]
    attached = [{**snippet, "id": str(n), "content": content} for n, content in enumerate(contents)]
    rows = [pages.page("u", 0, [pages.message("1", attachments=[*attached, {"contentUrl": "plain"}]), pages.message("2")])]
    checked = checked_messages(explode_pages(pages.frame(spark, rows)))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 or plan.count("parse_json") == 1, plan
    found = {r["message_id"]: (json.loads(r["rawJson"]), r["bad_urls"]) for r in checked.collect()}
    message, bad = found["1"]
    assert [a["contentUrl"] for a in message["attachments"]] == ["u", None, "stored", None, "stored", "stored", "plain"]
    assert bad == 2 and found["2"][1] == 0 and found["2"][0]["attachments"] is None
