import datetime as dt
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadhaul import functions as X
from threadhaul import schemas as S


def evaluate(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v")).alias("r")).collect()]


def test_id_key(spark):
    given_ids = ["12", " 12 ", "+12", "-3", "12.5", "abc", "", "1,000", "9223372036854775808", None]
    assert evaluate(spark, given_ids, X.id_key) == [12, 12, 12, -3, 0, 0, 0, 0, 0, 0]
    edge = ["9223372036854775807", "-9223372036854775808", "1e3", "0x10", "--1", " 5", "٣", "1 2"]
    assert evaluate(spark, edge, X.id_key) == [2**63 - 1, -(2**63), 0, 0, 0, 0, 0, 0]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-(2**70), 2**70).map(str), st.text(max_size=8)), min_size=20, max_size=60))
def test_id_key_is_a_strict_whole_number(spark, values):
    values = [v for v in values if "\x00" not in v and not any(0xD800 <= ord(c) < 0xE000 for c in v)]

    def expected(text):
        if re.fullmatch(r"[\t-\r ]*[+-]?[0-9]+[\t-\r ]*", text):
            number = int(text)
            return number if -(2**63) <= number < 2**63 else 0
        return 0

    assert evaluate(spark, values, X.id_key) == [expected(v) for v in values]


def test_folder_date(spark):
    times = ["2024-05-01T10:11:12Z", None, "2024-05-01T23:30:00-02:00"]
    got = evaluate(spark, times, lambda v: X.folder_date(v.cast("timestamp")).cast("string"))
    assert got == ["2024-05-01 00:00:00", None, "2024-05-02 00:00:00"]


SENDERS = [
    ('{"user":{"displayName":"d"},"application":{"id":"a"}}', (None, "d", None, None, "user")),
    ('{"user":null,"application":{"id":"a","applicationIdentityType":"bot"}}', ("a", None, "bot", None, "application")),
    ('{"application":{"id":"a","tenantId":"t"}}', ("a", None, None, None, "application")),
    ('{"user":{}}', (None, None, None, None, "user")),
    ('{"user":{"id":"u","tenantId":"t","userIdentityType":"k"}}', ("u", None, "k", "t", "user")),
    ('{"device":"x"}', (None, None, None, None, "device")),
    ("{}", (None,) * 5),
    ("null", (None,) * 5),
]


def test_sender_columns(spark):
    texts = ['{"from":%s}' % s for s, _ in SENDERS] + ["{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    message = rows.select("i", F.from_json("j", S.PAYLOAD).alias("m"))
    columns = X.sender_columns(X.sender(F.col("m")))
    got = message.orderBy("i").select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [tuple(r) for r in got] == [want for _, want in SENDERS] + [(None,) * 5]


SNIPPET = S.CODE_SNIPPET_TYPE
URLS = [
    (SNIPPET, '{"codeSnippetUrl":"U"}', "U", False),
    (SNIPPET, "", "S", False),
    (SNIPPET, None, "S", False),
    (SNIPPET, "[1]", "S", False),
    (SNIPPET, "bad", None, True),
    (SNIPPET, "{}", None, True),
    (SNIPPET, '{"codeSnippetUrl":null}', None, False),
    (SNIPPET, '{"codeSnippetUrl":5}', None, True),
    (SNIPPET.upper(), '{"codeSnippetUrl":"U"}', "S", False),
    ("reference", '{"codeSnippetUrl":"U"}', "S", False),
    (None, '{"codeSnippetUrl":"U"}', "S", False),
]


def test_attachment_url(spark):
    rows = spark.createDataFrame(
        [(i, (t, "S", c)) for i, (t, c, _, _) in enumerate(URLS)],
        "i int, a struct<contentType string, contentUrl string, content string>",
    ).orderBy("i")
    a = F.col("a")
    got = rows.select(X.attachment_url(a), X.attachment_url_problem(a)).collect()
    assert [tuple(r) for r in got] == [(url, bad) for _, _, url, bad in URLS]


def test_attachment_and_reaction_keys(spark):
    row = spark.createDataFrame([((None, "t"),)], "a struct<id string, contentType string>")
    assert row.select(X.attachment_key(F.col("a"))).first()[0] == "_t"
    keys = spark.range(1).select(
        X.reaction_key(F.lit("2024-05-01T10:11:12.5Z").cast("timestamp"), F.lit("u"), F.lit("like")),
        X.reaction_key(F.lit(None).cast("timestamp"), F.lit(None).cast("string"), F.lit("like")),
    )
    assert tuple(keys.first()) == ("2024-05-01T10:11:12.500000Z_u_like", "__like")


def test_conversation_type(spark):
    kinds = {
        "19:meeting_x@thread.v2": "Meeting",
        "19:x@threadtac.v2": "Channelconversation",
        "19:x@thread.v2": "Group",
        "19:x@unq.gbl.spaces": "OneOnOne",
        " 48:NOTES ": "Notes",
        "\t48:notes\n": "Notes",
        "zzz": "Undefined",
        "": "Undefined",
        "19:meeting_x@threadtac.v2": "Channelconversation",
        "19meetingMDgthreadv2": "Undefined",
    }
    assert evaluate(spark, list(kinds), X.conversation_type) == list(kinds.values())


def test_times(spark):
    assert evaluate(spark, [1704067200001], lambda v: X.unix_ms_to_ts(v).cast("string"), "bigint") == [
        "2024-01-01 00:00:00.001"
    ]
    millis = evaluate(
        spark,
        [None, "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.998", "2024-01-01 00:00:00.0019"],
        lambda v: X.ts_to_unix_ms(v.cast("timestamp")),
    )
    assert millis == [0, 0, -2, 1704067200001]
    assert evaluate(
        spark, ["2024-01-01 10:00:00"], lambda v: F.unix_micros(X.specify_utc(v.cast("timestamp_ntz")))
    ) == [1704103200000000]


def test_wildcard(spark):
    names = ["allmailboxes1.JSON", "AllMailBoxes/a/b.json", "xAllMailBoxes.json", "AllMailBoxesXjson"]
    assert evaluate(spark, names, lambda v: X.wildcard_match(v, "AllMailBoxes*.json")) == [
        True,
        True,
        False,
        False,
    ]
    assert evaluate(spark, ["ab.json", "a?.json"], lambda v: X.wildcard_match(v, "a?.json")) == [False, True]
    assert evaluate(spark, ["ab.json"], lambda v: X.wildcard_match(v, "*")) == [True]
    assert evaluate(spark, ["a[1].txt", "a1.txt"], lambda v: X.wildcard_match(v, "*a[1].txt")) == [True, False]


def test_is_guid(spark):
    digits = "b4b488a1b5e542978d22f99ba5cf154e"
    dashed = "b4b488a1-b5e5-4297-8d22-f99ba5cf154e"
    good = [dashed, "{%s}" % dashed, "(%s)" % dashed, digits, f" {dashed.upper()} "]
    good.append("{0xb4b488a1,0xb5e5,0x4297,{0x8d,0x22,0xf9,0x9b,0xa5,0xcf,0x15,0x4e}}")
    bad = ["zz", "", None, "{%s)" % dashed, dashed[:-1], digits + "0", dashed.replace("-", "_")]
    assert evaluate(spark, good + bad, X.is_guid) == [True] * len(good) + [False] * len(bad)


def test_parse_bound(spark):
    got = evaluate(
        spark,
        ["2023-01-01Z", "2025-12-31T23:59:59Z", "2024-05-01T00:00:00+02:00", "2024-05-01", "x", "", None],
        lambda v: X.parse_bound(v).cast("string"),
    )
    assert got == [
        "2023-01-01 00:00:00",
        "2025-12-31 23:59:59",
        "2024-04-30 22:00:00",
        "2024-05-01 00:00:00",
        None,
        None,
        None,
    ]


def test_blank_and_names(spark):
    assert evaluate(spark, [None, "", "a", " "], X.is_blank) == [True, True, False, False]
    assert evaluate(spark, [None, "", "a"], X.null_if_empty) == [None, None, "a"]
    assert evaluate(spark, [0, 1, 12], lambda v: X.series_name("log.txt", v), "bigint") == [
        "log.txt",
        "log_1.txt",
        "log_12.txt",
    ]
    assert evaluate(spark, [2], lambda v: X.series_name("log", v), "bigint") == ["log_2"]


def test_rand_integer_range(spark):
    row = spark.range(5000).select(X.rand_integer(-3, 4, seed=1).alias("r"))
    low, high, kinds = row.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first()
    assert (low, high, kinds) == (-3, 3, 7)


EMPTY_USER_X = {"@odata.type": None, "application": None, "device": None, "user": None}
EMPTY_USER = {
    "@odata.type": None,
    "id": None,
    "displayName": None,
    "userIdentityType": None,
    "tenantId": None,
    "application": None,
    "device": None,
}


def written(spark, text):
    row = spark.createDataFrame([(text,)], "j string").select(
        X.raw_json(F.from_json("j", S.PAYLOAD)).alias("r")
    )
    return json.loads(row.first()["r"])


def test_raw_json_defaults_for_absent_keys(spark):
    out = written(spark, '{"id":"1"}')
    assert list(out) == [
        "id", "replyToId", "etag", "messageType", "createdDateTime", "lastModifiedDateTime",
        "lastEditedDateTime", "deletedDateTime", "subject", "summary", "chatId", "importance",
        "locale", "webUrl", "eventDetail", "from", "body", "attachments", "reactions", "mentions",
        "messageHistory",
    ]
    assert out["eventDetail"] == {
        "@odata.type": None,
        "visibleHistoryStartDateTime": None,
        "initiator": EMPTY_USER_X,
        "members": [],
        "callParticipants": [],
    }
    assert out["from"] == {"application": None, "device": None, "user": None}
    assert out["body"] is out["attachments"] is out["reactions"] is out["mentions"] is None


def test_raw_json_keeps_explicit_nulls(spark):
    out = written(
        spark,
        '{"from":null,"eventDetail":null,"reactions":[null,{"user":null}],"mentions":[{"mentioned":null}],'
        '"messageHistory":[{"reaction":null}]}',
    )
    assert out["from"] is None and out["eventDetail"] is None
    assert out["reactions"] == [None, {"reactionType": None, "createdDateTime": None, "user": None}]
    assert out["mentions"] == [{"id": 0, "mentionText": None, "mentioned": None}]
    assert out["messageHistory"] == [{"modifiedDateTime": None, "actions": None, "reaction": None}]


def test_raw_json_nested(spark):
    source = {
        "id": "1",
        "lastModifiedDateTime": "2024-05-01T10:11:12.1234567Z",
        "unknown": 1,
        "eventDetail": {
            "@odata.type": "#x",
            "initiator": {"application": {"n": [1, {"z": "ü"}]}, "user": {"id": "u"}},
            "members": None,
            "callParticipants": [{"participant": {"device": 7}}, {"participant": None}],
        },
        "from": {"application": {"odatatype": "k", "@odata.type": "dropped", "id": "a"}},
        "body": {"contentType": "html", "content": "<p>&'+ü</p>"},
        "attachments": [
            {"id": "1", "contentType": SNIPPET, "content": '{"codeSnippetUrl":"U"}', "contentUrl": "S"}
        ],
        "mentions": [{"id": 3, "mentioned": {"user": {"id": "m"}}}, {}],
        "messageHistory": [{"actions": "add", "reaction": {"reactionType": "like"}}],
    }
    out = written(spark, json.dumps(source))
    assert "unknown" not in out
    assert out["lastModifiedDateTime"] == "2024-05-01T10:11:12.123456Z"
    detail = out["eventDetail"]
    assert detail["initiator"] == {
        **EMPTY_USER_X,
        "application": {"n": [1, {"z": "ü"}]},
        "user": {**EMPTY_USER, "id": "u"},
    }
    assert detail["members"] is None
    assert detail["callParticipants"] == [
        {"participant": {**EMPTY_USER_X, "device": 7}},
        {"participant": None},
    ]
    assert out["from"]["application"] == {
        "odatatype": "k",
        "id": "a",
        "displayName": None,
        "applicationIdentityType": None,
    }
    assert out["body"] == source["body"]
    assert out["attachments"][0]["contentUrl"] == "U"
    assert out["mentions"] == [
        {"id": 3, "mentionText": None, "mentioned": {"user": {**EMPTY_USER, "id": "m"}}},
        {"id": 0, "mentionText": None, "mentioned": {"user": EMPTY_USER}},
    ]
    assert out["messageHistory"][0]["reaction"] == {
        "reactionType": "like",
        "createdDateTime": None,
        "user": EMPTY_USER_X,
    }


def test_settings_rules(spark):
    from threadhaul.settings import ExportSettings, SettingsError, page_size

    assert [page_size(n) for n in (9, 10, 1000, 1001, None)] == [800, 10, 1000, 800, 800]
    assert ExportSettings(model="C").model == "A"
    assert ExportSettings(model="B", page_size=5).page_size == 800
    with pytest.raises(SettingsError):
        ExportSettings(roster_pattern="")
    with pytest.raises(SettingsError):
        ExportSettings(start="2023-01-01Z").window(spark)
    with pytest.raises(SettingsError):
        ExportSettings(start="x", end="2023-01-01Z").window(spark)
    assert ExportSettings(start="2023-01-01Z", end="2023-02-01Z").window(spark) == (
        dt.datetime(2023, 1, 1),
        dt.datetime(2023, 2, 1),
    )
