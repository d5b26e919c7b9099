import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadhaul.operators import chain
from threadhaul.sources.files import (
    EmptySourceError,
    Listing,
    list_matching,
    matching_bytes,
    read_binary,
    read_whole_text,
    scan_wildcard_files,
    scan_wildcard_lines,
)
from threadhaul.sources.pages import explode_pages, parse_single_doc
from threadhaul.sources.roster import roster_rows, roster_rows_from_lines, split_roster


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "AllMailBoxes" / "deep").mkdir(parents=True)
    (root / "AllMailBoxes (1)+2.json").write_text("[]")
    (root / "AllMailBoxes" / "deep" / "x.JSON").write_text("a\nb")
    (root / "AllMailBoxesEmpty.json").write_text("")
    (root / "other.json").write_text("zz")
    return str(root)


def test_scan_matches_full_names(spark, folder):
    found = scan_wildcard_files(spark, folder, "AllMailBoxes*.json").collect()
    assert {(r["name"], r["size"], r["value"]) for r in found} == {
        ("AllMailBoxes (1)+2.json", 2, "[]"),
        ("AllMailBoxes/deep/x.JSON", 3, "a\nb"),
    }


def test_scan_guards(spark, folder, tmp_path):
    assert scan_wildcard_files(spark, folder, "none*").isEmpty()
    with pytest.raises(ValueError):
        scan_wildcard_files(spark, folder, "")
    (tmp_path / "void").mkdir()
    with pytest.raises(EmptySourceError):
        scan_wildcard_files(spark, str(tmp_path / "void"), "*")
    with pytest.raises(PySparkException):
        scan_wildcard_files(spark, str(tmp_path / "missing"), "*")


def test_scan_opens_only_matching_files(spark, folder):
    found = scan_wildcard_files(spark, folder, "AllMailBoxes*.json")
    found.collect()
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = scans.head().metrics()
    assert metrics.apply("numFiles").value() == 2


def test_whole_text_and_binary(spark, folder):
    assert {r["value"] for r in read_whole_text(spark, folder).collect()} == {"[]", "a\nb", "zz"}
    assert {bytes(r["content"]) for r in read_binary(spark, folder).collect()} == {b"[]", b"a\nb", b"zz"}


def rows_of(spark, *texts, strict=True):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_path string, value string")
    return roster_rows(files, strict)


def test_roster_names_comments_and_quarantine(spark):
    text = """/* all */ [{"displayname":"A","EXTERNALDIRECTORYOBJECTID":"1"}, // one
      {"ExternalDirectoryObjectId":"","DisplayName":"B"}, {"PrimarySmtpAddress":"c@x"},
      {"ExternalDirectoryObjectId":"2","externaldirectoryobjectid":"3","more":{"x":[1]}}]"""
    roster = split_roster(rows_of(spark, text))
    assert [tuple(r) for r in roster.mailboxes.select("position", "ExternalDirectoryObjectId", "DisplayName").collect()] == [
        (0, "1", "A"),
        (3, "3", None),
    ]
    assert [json.loads(r["object"]) for r in roster.quarantine.orderBy("position").collect()] == [
        {"DisplayName": "B", "ExternalDirectoryObjectId": "", "PrimarySmtpAddress": None},
        {"DisplayName": None, "ExternalDirectoryObjectId": None, "PrimarySmtpAddress": "c@x"},
    ]


def test_roster_null_element(spark):
    with pytest.raises(PySparkException, match="null roster object"):
        rows_of(spark, "[null]").collect()
    assert split_roster(rows_of(spark, "[null]", strict=False)).quarantine.count() == 1


@pytest.mark.parametrize("text", ["{}", "nonsense", '{"a":"b"}'])
def test_roster_must_be_an_array(spark, text):
    with pytest.raises(PySparkException, match="not a JSON array"):
        rows_of(spark, text).collect()


def test_roster_lines_keep_their_order(spark, tmp_path):
    lines = [json.dumps({"externalDirectoryObjectId": f"u{i % 50}", "DisplayName": str(i)}) for i in range(5000)]
    (tmp_path / "AllMailBoxes.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = roster_rows_from_lines(scan_wildcard_lines(spark, str(tmp_path), "*.jsonl"))
        assert rows.rdd.getNumPartitions() > 3
        from threadhaul.operators.dedupe import dedupe_last_wins
        from threadhaul.sources.roster import ROSTER_ORDER

        last = dedupe_last_wins(rows, ["ExternalDirectoryObjectId"], ROSTER_ORDER)
        got = {r["ExternalDirectoryObjectId"]: r["DisplayName"] for r in last.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"u{i}": str(4950 + i) for i in range(50)}


def test_explode_pages(spark, pages):
    rows = [
        pages.page("u", 0, [pages.message("1"), pages.message("2")], more=True),
        pages.page("u", 1, []),
        pages.page("v", 0, status=403),
        pages.page("w", 0, body='{"value":[null]}'),
        pages.page("x", 0, body="[1]"),
        pages.page("y", 0),
        pages.page("z", 0, body='{"value":[{"id":"1","createdDateTime":"no time"}]}'),
        pages.page("q", 0, body='{"Value":[{"id":"1"}]}'),
    ]
    out = explode_pages(pages.frame(spark, rows), keep_empty=True)
    got = {(r["mailbox"], r["page_no"], r["position"], r["malformed"]) for r in out.collect()}
    assert got == {
        ("u", 0, 0, False),
        ("u", 0, 1, False),
        ("u", 1, None, False),
        ("v", 0, None, False),
        ("w", 0, None, True),
        ("x", 0, None, True),
        ("y", 0, None, True),
        ("z", 0, None, True),
        ("q", 0, None, True),
    }
    assert explode_pages(pages.frame(spark, rows)).count() == 2


def test_parse_single_doc(spark, pages):
    good = [pages.page("u", 0, body='{"a":1}'), pages.page("v", 0, status=404)]
    docs = parse_single_doc(pages.frame(spark, good), "struct<a int>")
    assert [tuple(r) for r in docs.select("mailbox", "document.a").collect()] == [("u", 1)]
    with pytest.raises(PySparkException, match="failed to get data"):
        parse_single_doc(pages.frame(spark, [pages.page("u", 0, status=402)]), "struct<a int>").collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        parse_single_doc(pages.frame(spark, [pages.page("u", 0, body="bad")]), "struct<a int>").collect()


CHAINS = {
    # mailbox: (responses, pages that count, outcome)
    "done": ([(0, 200, "A", 1), (1, 200, "A", 0)], 2, chain.COMPLETE),
    "open": ([(0, 200, "A", 1)], 1, chain.OPEN),
    "skip": ([(0, 200, "A", 1), (1, 403, "A", 0), (2, 200, "A", 0)], 2, chain.SKIPPED),
    "gone": ([(0, 404, "A", 0)], 1, chain.SKIPPED),
    "unauthorized": ([(0, 401, "A", 0)], 1, chain.SKIPPED),
    "paid": ([(0, 402, "A", 0), (0, 200, "B", 0)], 2, chain.COMPLETE),
    "twice": ([(0, 402, "A", 0), (0, 402, "B", 0), (1, 200, "B", 0)], 2, chain.FAILED),
    "later": ([(0, 200, "A", 1), (1, 402, "A", 0), (1, 402, "B", 0)], 3, chain.FAILED),
    "nocontent": ([(0, 204, "A", 0), (1, 200, "A", 0)], 1, chain.FAILED),
    "broken": ([(0, 200, "A", 1), (1, 500, "A", 0)], 2, chain.FAILED),
}


def test_chains(spark, pages):
    rows = [
        (mailbox, page_no, status, model, "next" if more else None, None)
        for mailbox, (responses, _, _) in CHAINS.items()
        for page_no, status, model, more in responses
    ]
    frame = pages.frame(spark, rows)
    counted = {r["mailbox"]: r["count"] for r in chain.page_chain_prefix(frame).groupBy("mailbox").count().collect()}
    assert counted == {mailbox: count for mailbox, (_, count, _) in CHAINS.items()}
    outcomes = chain.chain_outcomes(chain.with_disposition(frame))
    assert {r["mailbox"]: r["outcome"] for r in outcomes.collect()} == {
        mailbox: outcome for mailbox, (_, _, outcome) in CHAINS.items()
    }
    assert {r["mailbox"] for r in chain.completed_users(outcomes).collect()} == {
        "done",
        "skip",
        "gone",
        "unauthorized",
        "paid",
    }


def test_model_b_first(spark, pages):
    rows = [("u", 0, 402, "B", None, None), ("u", 0, 200, "A", None, None)]
    judged = chain.with_disposition(pages.frame(spark, rows), "B").orderBy("chain_pos")
    assert [r["disposition"] for r in judged.collect()] == [chain.SWITCH, chain.CONSUME]
    row = spark.range(1).select(chain.classify_status(F.lit(402), F.lit(None).cast("string")))
    assert row.first()[0] == chain.SWITCH


def test_one_listing_tells_sizes_and_guards(spark, folder, monkeypatch):
    listing = list_matching(spark, folder, "AllMailBoxes*.json")
    assert listing == Listing(files=3, largest=3, bytes=5)
    assert list_matching(spark, folder, "nothing*") == Listing(files=3, largest=0, bytes=0)
    with pytest.raises(EmptySourceError):
        scan_wildcard_files(spark, folder, "*", Listing(0, 0, 0))
    loads = []
    load = type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda self, *a, **k: loads.append(a) or load(self, *a, **k))
    assert scan_wildcard_files(spark, folder, "AllMailBoxes*.json", listing).count() == 2
    assert not loads


def test_root_is_cut_as_a_prefix(spark, tmp_path, monkeypatch):
    """The root's name again below it, and other spellings of the root."""
    root = tmp_path / "data"
    nested = root / "x" / str(root).lstrip("/")
    nested.mkdir(parents=True)
    (root / "AllMailBoxes1.json").write_text("[]")
    (nested / "AllMailBoxes3.json").write_text("[]")
    monkeypatch.chdir(tmp_path)
    inner = f"x/{str(root).lstrip('/')}/AllMailBoxes3.json"
    for spelled in (str(root), f"{root}/", f"{tmp_path}//data", f"{root}/../data", f"file:{root}", f"file://{root}"):
        names = [r["name"] for r in scan_wildcard_files(spark, spelled, "*.json").collect()]
        assert sorted(names) == ["AllMailBoxes1.json", inner], spelled
        top = [r["name"] for r in scan_wildcard_files(spark, spelled, "AllMailBoxes*.json").collect()]
        assert top == ["AllMailBoxes1.json"], spelled
        assert matching_bytes(spark, spelled, "AllMailBoxes*.json") == 2


def test_line_rosters_are_strict_when_asked(spark):
    lines = spark.createDataFrame(
        [("f", 0, '{"ExternalDirectoryObjectId":"a"}'), ("f", 0, "null"), ("f", 0, "not json"), ("f", 0, " "), ("f", 0, "// note")],
        "name string, block_start long, value string",
    )
    roster = split_roster(roster_rows_from_lines(lines))
    assert [r["ExternalDirectoryObjectId"] for r in roster.mailboxes.collect()] == ["a"]
    assert sorted(r["raw"] for r in roster.quarantine.collect()) == ["not json", "null"]
    with pytest.raises(Exception, match="not a roster object"):
        roster_rows_from_lines(lines, strict=True).collect()
