"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyreel.llm import periods

FIBONACCI = ["a", "ab"]
while len(FIBONACCI) < 12:
    FIBONACCI.append(FIBONACCI[-1] + FIBONACCI[-2])


def plain_runs(words):
    """Every maximal stretch of every lag; a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    """Words in which runs of many kinds meet: squares, seams of two repetitions, few letters."""
    kind = rng.randrange(5)
    letters = "ab" if kind < 2 else "abc" if kind < 4 else "abcdefgh"
    words = [rng.choice(letters) for _ in range(rng.randrange(60))]
    if kind in (1, 3):
        for _ in range(3):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 15))]
            words += (unit * rng.randrange(2, 14))[: rng.randrange(90)]
            words += [rng.choice(letters) for _ in range(rng.randrange(4))]
    if kind == 2:
        half = words * 2
        words = half + half[: rng.randrange(len(half) + 1)] + words
    return words


SPECIAL = [
    list("b" + "ab" * 9 + "a" + "ba" * 12 + "c"),
    ["x"] * 11,
    ["x"] * 12,
    list(FIBONACCI[-1]),
    list(("ab" * 4 + "a") * 2),
    list("abcdefg" * 2),
    list("abcdef" * 2) + ["z"] + list("abcdefg" * 2),
    [str(i) for i in range(100)] * 2,
]


def test_runs_equal_a_scan_of_every_lag():
    rng = random.Random(3)
    texts = SPECIAL + [some_words(rng) for _ in range(3000)]
    number = {}
    for at in range(0, len(texts), 50):  # documents of one slice, told apart by their numbers
        part = texts[at : at + 50]
        ids = [number.setdefault((i, w), len(number)) for i, t in enumerate(part, at) for w in t]
        runs = periods.runs_of(np.array(ids, dtype=np.int64))
        want, before = [], 0
        for t in part:
            want += [(s + before, n, q) for s, n, q in plain_runs(t)]
            before += len(t)
        assert list(zip(*[c.tolist() for c in runs], strict=True)) == want


def test_seeds_stay_few_where_one_word_fills_a_text():
    words = np.zeros(200_000, dtype=np.int64)
    words[100_000] = 1
    grams = periods._index(words)
    tried = [len(periods._seeds(g, k, k if k > 6 else 1, 2 * k)[0]) for k, g in grams.items() if k >= 6]
    assert max(tried) <= 6 * len(words)
    # One run on either side of the odd word; those across it would need it twice.
    assert [c.tolist() for c in periods.runs_of(words)] == [[0, 100_001], [100_000, 99_999], [1, 1]]


def test_texts_of_every_kind(table):
    long = " ".join(["over", "and"] * 40_000)
    texts = [None, "", " \t\n", "one", "é " * 12, "a\x0bb\x0cc " * 6, "x y " * 13, long, "é " * 12]
    texts += [" ".join(w) for w in SPECIAL]
    rows = [(i % 9, t, "own", "kept") for i, t in enumerate(texts)] + [(None, "q " * 20, None, None)]
    found = periods.periodic_runs(table(rows, "doc_id long, text string, runs string, rest string"))
    got = sorted((r["rest"]["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    want = []
    for i, text, _, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = [(0, 80_000, 2)] if text == long else plain_runs(words)
        want.append((i or -1, len(words), runs, plain_kept(words, runs)))
    assert got == sorted(want)
    assert found.select("rest.runs", "rest.rest").distinct().count() == 2
    assert periods.periodic_runs(table([])).collect() == []


def plain_query(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(plain_kept(words, runs).encode()).hexdigest(),
    )


@pytest.mark.parametrize("n", [0, 300])
def test_the_query_equals_a_plain_one(spark, table, tmp_path, n):
    rng = random.Random(5)
    rows = [(rng.choice([None, i, -i, 10**15 + i]), " ".join(some_words(rng))) for i in range(n)]
    rows += [(7, None), (10, ""), (None, None)] if n else []
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periods.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([plain_query(*r) for r in rows], key=repr)
