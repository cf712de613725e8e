import datetime as dt
import json

import pytest

from tallyreel.plans import replies

BAD, LIST = replies.UNREADABLE, replies.NOT_AN_OBJECT

# Each stored text with the object it holds, or the error it gives.
TEXTS = [
    ('{"a": 1}', {"a": 1}),
    ('```json\n{"a": [1, {"b": null}]}\n```', {"a": [1, {"b": None}]}),
    ('```\n{"a": 1}\n```  ', {"a": 1}),
    ('json {"a": "x"}', {"a": "x"}),
    ('JSON\n{"a": 1.5}', {"a": 1.5}),
    ('```json\n{"a": 1}', {"a": 1}),
    ('```json\r\n{"a": 1}\r\n```', {"a": 1}),
    (' {"a": "é"} ', {"a": "é"}),
    ('{"a": {"b": "```"}}', {"a": {"b": "```"}}),
    ("{}", {}),
    ("not json", BAD),
    ("", BAD),
    ("   ", BAD),
    ("```", BAD),
    ("```json", BAD),
    ("json", BAD),
    ('{"a": 1} trailing', BAD),
    ('{"a": 1}{', BAD),
    ('{"a": 1}, {"b": 2}', BAD),
    ('{"a": 1}] [', BAD),
    ('{"a": 1}} {"v": {', BAD),
    ('{"a": 1}\n```', BAD),
    ("x" * 700, BAD),
    ("[1]", LIST),
    ("3", LIST),
    ('"text"', LIST),
    ("null", LIST),
    ("```json\n[1, 2]\n```", LIST),
]


def test_replies_give_an_object_or_an_error(spark):
    rows = spark.createDataFrame(
        [(str(i), t, dt.datetime(2024, 1, 1)) for i, (t, _) in enumerate(TEXTS)],
        "cache_key string, response string, created_at timestamp_ntz",
    )
    got = {int(r["cache_key"]): r for r in replies.normalise(rows).collect()}
    for i, (text, result) in enumerate(TEXTS):
        if isinstance(result, dict):
            assert (json.loads(got[i]["reply"]), got[i]["error"], got[i]["raw"]) == (result, None, None), text
        else:
            assert (got[i]["reply"], got[i]["error"], got[i]["raw"]) == (None, result, text[:500]), text


def test_only_fresh_replies_are_read(spark, tmp_path):
    rows = spark.createDataFrame(
        [("k", "{}", dt.datetime(2024, 1, 9))], "cache_key string, response string, created_at timestamp_ntz"
    )
    rows.write.parquet(f"{tmp_path}/replies")
    live = replies.live(spark.read.parquet(f"{tmp_path}/replies"), dt.datetime(2024, 1, 10))
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan


@pytest.mark.parametrize("hours,is_live", [(23, True), (24, True), (25, False)])
def test_reply_age(spark, hours, is_live):
    now = dt.datetime(2024, 1, 10)
    rows = spark.createDataFrame(
        [("k", "{}", now - dt.timedelta(hours=hours)), ("k", '{"old": 1}', now - dt.timedelta(days=9))],
        "cache_key string, response string, created_at timestamp_ntz",
    )
    live = [r["reply"] for r in replies.live(rows, now).collect()]
    assert live == (["{}"] if is_live else [])


def test_unreadable_replies_are_not_live(spark):
    now = dt.datetime(2024, 1, 10)
    rows = spark.createDataFrame(
        [("k", "oops", now)], "cache_key string, response string, created_at timestamp_ntz"
    )
    assert replies.live(rows, now).count() == 0
    assert replies.live(rows, now, keep_errors=True).count() == 1


def test_contexts_meet_their_live_replies(spark):
    keys = spark.createDataFrame([("c1", "k"), ("c2", "x")], "channel_id string, cache_key string")
    live = spark.createDataFrame([("k", "{}")], "cache_key string, reply string")
    rows = {r["channel_id"]: (r["reply"], r["from_cache"]) for r in replies.with_replies(keys, live).collect()}
    assert rows == {"c1": ("{}", True), "c2": (None, False)}
