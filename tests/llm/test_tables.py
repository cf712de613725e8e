"""URL rules, tool calls, the pipeline, and the registered queries that have no SQL."""

import json
import random

import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyreel.llm import queries, toolcalls, urls


def test_rules_fit_hosts_subdomains_and_longest_paths(spark):
    rows = [
        ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("https://x.com/fr/a://b", "x.com", "/fr/a://b", "com/fr/", "allow"),
        ("https://x.org", "x.org", "", None, None),
        ("https://x.org?a=1/", "x.org", "", None, None),
        ("x.org/es/", "", "", None, None),
        ("://", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://É.org/é", "É.org", "/é", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "mine") for i, r in enumerate(rows)], "page_id long, url string, score string")
    found = {r["page_id"]: r for r in urls.judge(pages, urls.RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] in ([verdict] if verdict else ["allow", "block"])
        assert 0 <= found[i]["score"] <= 1


def test_trees_learn_from_labelled_urls_and_need_both_labels(spark):
    rng = random.Random(1)
    rows = [(i, f"https://a{i}.org/en/{'page' if i % 2 else '9' * 12}{rng.randrange(99)}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [urls.Rule("org/en/9", "block"), urls.Rule("org/en/p", "allow")]
    other = spark.createDataFrame([(1000, "https://b.net/en/99999999999923"), (1001, "https://b.net/en/page7")], pages.schema)
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages.union(other), rules).collect()}
    assert (found[1000], found[1001]) == ("block", "allow")
    one_label = urls.judge(pages, rules[:1] + [urls.Rule("net/", "block")]).filter("rule IS NULL")
    assert one_label.select("verdict").distinct().collect() == [("block",)]
    assert urls.judge(pages, []).select("verdict").distinct().collect() == [("allow",)]
    assert urls.judge(pages.limit(0), rules).collect() == []


MESSAGES = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, at string"


def test_calls_are_linked_ordered_validated_and_serialised(spark):
    def call(turn, call_id, arguments, tool="search"):
        return (1, turn, "assistant", None, call_id, tool, arguments, "x")

    def result(turn, call_id):
        return (1, turn, "tool", f"r{turn}", call_id, None, None, "x")

    def refers(to):
        return json.dumps({"query": "q", "after": {"$ref": to}})

    rows = [
        (1, 0, "user", 'say "é"\n', None, None, None, "x"),
        result(1, "c"),  # before its call
        call(2, "c", '{"query": "q", "limit": 3}'),
        call(3, "d", refers("e")),  # refers to a later call
        call(5, "e", refers("c")),
        result(6, "e"),
        result(7, "d"),
        call(8, "f", refers("g")),
        call(9, "g", refers("f")),
        result(10, "f"),
        result(11, "g"),
        result(12, "nobody"),
        call(13, "c", "{}"),
        call(14, "h", '{"query": 1, "limit": true, "more": 0}'),
        call(15, "i", '{"a": 1, "a": 2}'),
        call(16, "j", "[1]"),
        call(17, "k", '{"page": "p", "mode": "pdf"}', "open"),
        call(18, "l", '{"query": "z", "limit": NaN}'),
        call(19, "m", "{}", "none"),
        call(20, "n", None),
        (None, 1, "assistant", "a", "c", "search", '{"query":"q"}', None),
        (2, 1, None, None, None, None, None, None),
    ]
    found = toolcalls.format_messages(spark.createDataFrame(rows, MESSAGES)).collect()
    assert len(found) == len(rows)
    own = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: (r["at"], r["depth"], r["turn"]))
    place = {(r["call_id"], r["is_call"]): i for i, r in reversed(list(enumerate(own)))}
    for name in "cde":
        assert place[name, True] < place[name, False]
    assert place["c", False] < place["e", True] and place["e", False] < place["d", True]
    status = {(r["turn"], r["call_id"]): r["status"] for r in own}
    assert [status[k] for k in [(0, None), (1, "c"), (2, "c"), (8, "f"), (9, "g"), (12, "nobody"), (13, "c"), (14, "h")]] == [
        "plain", "linked", "answered", "cycle", "cycle", "orphan", "repeated", "unanswered",
    ]
    faults = {r["call_id"]: r["faults"] for r in own if r["turn"] > 13}
    assert faults["h"] == ["limit: not integer", "query: not string", "more: unknown"]
    assert faults["i"] == faults["l"] == faults["n"] == ["arguments are not JSON"]
    assert faults["j"] == ["arguments are not an object"] and faults["m"] == ["unknown tool"]
    assert faults["k"] == ["mode: not a listed value"]
    messages = {r["turn"]: r["message"] for r in own}
    assert messages[0] == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert messages[2] == (
        '{"content":null,"role":"assistant","tool_calls":'
        '[{"arguments":{"limit":3,"query":"q"},"id":"c","name":"search"}]}'
    )
    assert toolcalls.format_messages(spark.createDataFrame([], MESSAGES)).collect() == []


def test_the_pipeline_keeps_clean_documents_and_applies_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{compare.FOLDER}/documents.parquet").limit(150)
    leak = spark.read.parquet(f"{compare.FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    long_text = " ".join(r["text"] for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(3).collect())
    extra = [
        (10_000, "999 !!! 123", "en", "s", 11),
        (10_001, None, "en", "s", 0),
        (10_002, long_text, "en", "s", len(long_text)),
        (10_003, long_text, "en", "s", len(long_text)),
        (10_004, f"The the of and {leak} and is was", "en", "s", len(leak) + 28),
    ]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("ids", F.lit("mine"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{compare.FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not {10_000, 10_001, 10_003, 10_004} & set(rows)
    # What stays of a text is its encoded form, and no copy of another's passages.
    assert all(r["decoded"] and len(r["ids"]) == len(r["begins"]) for r in rows.values())
    assert len(rows) > 100
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.collect() == []


@pytest.mark.parametrize("name", sorted(set(queries.LLM_QUERIES) - set(queries.LLM_ORACLES)))
def test_queries_without_sql_answer(spark, name):
    frame = queries.LLM_QUERIES[name](spark, compare.FOLDER)
    assert not frame.isEmpty()


def test_few_urls_on_very_many_rows_are_all_learned_from(table):
    names = [f"https://{'shop' if i % 2 else 'wiki'}.org/{'x' * (40 * (i % 2))}{i}" for i in range(20)]
    rows = [(i, name) for name in names for i in range(50)] + [(99, f"https://other.org/{'x' * 40}7")]
    rules = [urls.Rule("shop.org/", "block"), urls.Rule("wiki.org/", "allow")]
    found = urls.judge(table(rows, "page_id long, url string"), rules, fit_rows=5).collect()
    assert {r["verdict"] for r in found if r["page_id"] == 99} == {"block"}
    assert all(r["verdict"] == ("block" if "shop" in r["url"] else "allow") for r in found if r["page_id"] < 50)
