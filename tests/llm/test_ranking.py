"""Ranked search against plain Python, with ties, heavy terms and small tiles."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyreel.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, places=20):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // max(1, n_terms)
            score = 0
            for t, q in wanted.items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += q * w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score and doc is not None:
                scored.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:places], 1)]
    return out


def some_text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", " \x00"]) for _ in range(rng.randrange(n)))


WORDS = ["the", "The", "THE", "été", "ÉTÉ", "x1", "日本", "tail", "rare", "ß", "ſ", "é́"] + [f"w{i}" for i in range(40)]


def some_rows(seed, n_docs, n_items):
    rng = random.Random(seed)
    docs = [(rng.randrange(n_docs), some_text(rng, WORDS, 30)) for _ in range(n_docs)]
    docs += [(i, docs[0][1] or "the") for i in range(900, 960)]  # more ties than places
    docs += [(1, None), (2, ""), (3, "- _ -"), (None, "rare tail the"), (5, "the " * 50_000)]
    items = [(i, some_text(rng, WORDS, 12)) for i in range(n_items)]
    items += [(1, "the the THE rare"), (1, "the the THE rare"), (None, "the"), (77, None), (78, "unheard-of"), (79, "")]
    return docs, items


@pytest.mark.parametrize("sizes", [(256, 1 << 14, 1 << 21, 4 << 20), (3, 20, 64, 4 << 20), (3, 20, 64, 0)])
def test_ranks_equal_plain_ones(table, monkeypatch, sizes):
    names = ("TILE_ITEMS", "TILE_TERMS", "BLOCK_NUMBERS", "SENT_BYTES")
    for name, value in zip(names, sizes, strict=True):
        monkeypatch.setattr(ranking, name, value)
    docs, items = some_rows(1, 200, 20)
    found = ranking.rank(table([(*r, 0) for r in docs], "doc_id long, text string, row int"), table(items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(plain_ranks(docs, items), key=repr)


def test_groups_of_items_change_nothing(table, monkeypatch):
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    docs, items = some_rows(2, 60, 6)
    found = ranking.rank(table(docs), table(items, "item_id long, text string"), places=3, group_bytes=150)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(plain_ranks(docs, items, 3), key=repr)


def test_empty_tables(table):
    docs, items = some_rows(3, 5, 1)
    item = "item_id long, text string"
    assert ranking.rank(table([]), table(items, item)).collect() == []
    assert ranking.rank(table(docs), table([], item)).collect() == []
    assert ranking.rank(table([(1, None)]), table(items, item)).collect() == []


def test_sums_beyond_float64_stay_exact():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 1 << 33, (4, 9)).astype(float)
    weights[1, 4] = float((1 << 43) - 1)
    block = rng.integers(0, ranking.MOST_IMPACT, (9, 5)).astype(float)
    got = sum(ranking._product(weights[:, p], block[p]) for p in ranking._parts(weights))
    want = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in block.T] for r in weights]
    assert got.tolist() == want and max(map(max, want)) > ranking.EXACT


def test_places_survive_any_order_of_blocks():
    rng = random.Random(4)
    rows = [(rng.randrange(1, 6), d) for d in rng.sample(range(1000), 200)]
    best = ranking._Best(1, 7)
    for at in range(0, len(rows), 30):
        part = rows[at : at + 30]
        best.offer(np.array([[s for s, _ in part]]), np.array([d for _, d in part]))
    want = sorted(rows, key=lambda r: (-r[0], r[1]))[:7]
    assert list(zip(best.score[0].tolist(), best.doc[0].tolist(), strict=True)) == want
