"""Queries without SQL over whole tables: the columns that plain Python can tell exactly."""

import random
import re
import zlib

import compare
import pyarrow.parquet as pq

from tallyreel.llm import queries, urls


def plain_host_and_path(url):
    """Host between the first :// and the next of / ? # or the end, path from there to ? # or the end."""
    before, mark, after = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    """The longest rule whose host is the URL's or a parent of it, and whose path begins the URL's."""
    fitting = [
        rule
        for rule in urls.RULES
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
    ]
    return max(fitting, key=lambda rule: len(rule.text), default=None)


def agrees(row, url):
    host, path = plain_host_and_path(url)
    rule = plain_rule(host, path)
    verdicts = [rule.verdict] if rule else ["allow", "block"]
    said = (row["host"], row["path"], row["rule"])
    return said == (host, path, rule.text if rule else None) and row["verdict"] in verdicts


def test_every_page_is_judged_by_its_rule(spark):
    given = pq.read_table(f"{compare.FOLDER}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    found = queries.LLM_QUERIES["op7_url_filter"](spark, compare.FOLDER).collect()
    known = {r["page_id"]: r["url"] for r in given}
    assert sorted(r["page_id"] for r in found) == sorted(r["page_id"] for r in given)
    assert [r for r in found if not agrees(r, known[r["page_id"]])] == []
    assert any(r["rule"] for r in found) and any(r["rule"] is None for r in found)


def test_random_urls_are_judged_by_their_rule(spark):
    rng = random.Random(8)
    parts = [
        "://", "/", "?", "#", ".", "http", "EXAMPLE", "example.org", "org", "com", "net", "É", "\n", " ",
        "/es/", "/en/1", "/fr/", "/de/", "es", "en", "1", "%2F", "@", ":80",
    ]
    given = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)]
    given += [f"http://{rng.choice(parts)}{rng.choice(['.', ''])}example.org{rng.choice(parts)}{rng.choice(parts)}" for _ in range(500)]
    given += [None, "", "https://example.org/es/" + "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    found = urls.judge(pages, urls.RULES).collect()
    assert len(found) == len(given)
    assert [r for r in found if not agrees(r, given[r["page_id"]])] == []


def test_every_document_gets_a_learned_language(spark):
    """Held-out rows by the checksum of their id; their languages are told without having been learned from."""
    columns = ["doc_id", "text", "lang"]
    given = {r["doc_id"]: r for r in pq.read_table(f"{compare.FOLDER}/documents.parquet", columns=columns).to_pylist()}
    found = queries.LLM_QUERIES["op10_language_id"](spark, compare.FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    learned = {r["lang"] for i, r in given.items() if r["lang"] and zlib.crc32(str(i).encode()) % 4 != 2}
    for r in found:
        lettered = any(c.isalpha() for c in given[r["doc_id"]]["text"] or "")
        assert (r["lang_pred"] in learned) if lettered else (r["lang_pred"] == "und")
        assert 0 <= r["score"] <= 1
    unseen = [r for r in found if r["held_out"] and given[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == given[r["doc_id"]]["lang"] for r in unseen)
    assert unseen and right >= 0.9 * len(unseen)
