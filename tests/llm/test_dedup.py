"""Passage, byte and near-duplicate removal against plain Python."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tallyreel.llm import exchange, near, passages, suffixes
from tallyreel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return [f"w{v:x}é"[:5] + "abcdefgh"[: v % 7] for v in rng.integers(0, vocabulary, n)]


def corpus():
    """Shared passages at many offsets, copies, near copies, ties, empties, a very long text."""
    shared = [prose(100 + i, 40 + 13 * i) for i in range(4)]
    rows = []
    for i in range(60):
        words = prose(i, 30 + 3 * i)
        if i % 2:
            at = (7 * i) % len(words)
            words[at:at] = shared[i % 4][i % 5 : 20 + i % 17]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)]  # exact copies
    rows += [(200 + i, rows[i][1].replace(" ", "\n\t ", 3)) for i in range(0, 60, 9)]
    rows += [(300, ""), (301, None), (302, " \n"), (303, "one"), (304, " ".join(prose(100, 40)[:13]))]
    rows += [(305, "same words again " * 40), (306, "same words again " * 30)]
    rows += [(400, " ".join(prose(7, 20_000))), (401, " ".join(prose(7, 20_000)[5_000:6_000]))]
    return rows + [(5, rows[5][1]), (5, rows[6][1])]  # a repeated row, and an id with two texts


def earlier_windows(rows, cut, size):
    """Of each row the windows that also start in a row with a smaller id."""
    first = {}
    for doc, units in rows:
        for i in range(len(units) - size + 1):
            key = cut(units[i : i + size])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, units in rows:
        gone = [False] * len(units)
        for i in range(len(units) - size + 1):
            if first[cut(units[i : i + size])] < doc:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def test_passages_equal_brute_force(table):
    rows = corpus()
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    expected = sorted(
        (d, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y))
        for (d, w), g in zip(split, earlier_windows(split, tuple, 13), strict=True)
    )
    found = passages.remove_repeats(table(rows)).select("id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, found.collect())) == expected
    assert sum(e[2] for e in expected) > 1_000


def test_bytes_equal_brute_force(table):
    rows = [r for r in corpus() if r[0] < 400]
    split = [(d, (t or "").encode()) for d, t in rows]
    expected = []
    for (d, b), g in zip(split, earlier_windows(split, bytes, 50), strict=True):
        runs = len(re.findall("x+", "".join("x" if y else " " for y in g)))
        expected.append((d, len(b), sum(g), runs, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    found = suffixes.remove_repeats(table(rows)).select("id", "n_bytes", "n_removed", "n_spans", "kept")
    found = [(*r[:4], bytes(r[4] or b"")) for r in found.collect()]
    assert sorted(found) == sorted(expected)


def test_a_null_text_stays_null_and_cuts_can_keep_characters_whole(table):
    rows = [(1, "é" * 40), (2, "xé" * 3 + "é" * 40 + "ñ"), (3, None), (None, "é" * 40), (None, "é" * 40)]
    found = {}
    for r in suffixes.remove_repeats(table(rows), characters=True).collect():
        found.setdefault(r["id"], []).append(r["kept"] if r["kept"] is None else bytes(r["kept"]).decode())
    assert found[3] == [None] and found[1] == ["é" * 40]
    assert found[None] == ["", ""]  # after every id
    assert all("�" not in t for t in found[2])


@pytest.mark.parametrize("operator", [passages, suffixes])
def test_other_columns_come_back_whatever_their_names(table, operator):
    columns = "doc_id long, text string, chunk string, id int, rest double, n_removed int"
    rows = [(1, "a b", "c1", 7, 0.5, None), (2, None, None, None, None, 3)]
    found = operator.remove_repeats(table(rows, columns))
    back = found.select("id", "rest.chunk", F.col("rest.id").alias("x"), "rest.rest", "rest.n_removed")
    assert sorted(map(tuple, back.collect())) == [(1, "c1", 7, 0.5, None), (2, None, None, None, 3)]


@pytest.mark.parametrize("operator", [passages, suffixes])
def test_an_empty_table_gives_an_empty_table(table, operator):
    assert operator.remove_repeats(table([])).collect() == []


def test_the_cover_meets_every_pair_of_places():
    places = range(passages.PERIOD)
    cover = set(passages.COVER)
    for a in places:
        for b in places:
            assert any({(a + s) % 7, (b + s) % 7} <= cover for s in places)


def test_keys_that_agree_in_half_their_bits_are_told_apart():
    table = np.array([(5, 1, 0), (5, 3, 0), (5, 9, 0), (8, 2, 0)], dtype=exchange.FIRST)
    keys, others = np.array([5, 5, 5, 8, 9], dtype=np.uint64), np.array([9, 1, 4, 2, 2], dtype=np.uint64)
    assert exchange.lookup(table, keys, others).tolist() == [2, 0, -1, 3, -1]


def exact_groups(rows, percent, size=5):
    sets = defaultdict(set)
    for d, t in rows:
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or [tuple(words)] * bool(words)
        sets[d, tuple(words)] = set(grams)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = list(sets.items())
    for i, ((a, _), x) in enumerate(named):
        for (b, _), y in named[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else f"e{seed}" for w in text.split())


def near_corpus():
    bases = [" ".join(prose(500 + i, 150 + 10 * i)) for i in range(12)]
    rows = [(i, b) for i, b in enumerate(bases)]
    rows += [(100 + 10 * i + k, edited(b, 31 * i + k, 0.004 * k)) for i, b in enumerate(bases) for k in range(7)]
    rows += [(300 + k, edited(bases[0], 900 + k, 0.01)) for k in range(60)]  # a group larger than a block
    rows += [(400, bases[3].upper()), (401, "a b c"), (402, "A  B\nC"), (403, "a b"), (404, ""), (405, None)]
    common = " ".join(prose(77, 30))
    return rows + [(500 + i, common + " " + " ".join(prose(800 + i, 40))) for i in range(40)]


def test_near_groups_equal_brute_force(table):
    rows = near_corpus()
    expected = exact_groups(rows, 85)
    found = near.near_duplicates(table(rows), block=16).collect()
    assert {r["id"]: r["component_id"] for r in found} == expected
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)
    sizes = {r["id"]: r["n_shingles"] for r in found}
    assert (sizes[401], sizes[403], sizes[404], sizes[405]) == (1, 1, 0, 0)


def sets_alike(n_pairs, percent, rng):
    """Pairs of shingle sets, one after the other, that just meet the threshold."""
    common, apart = 20 * percent, 20 * (100 - percent) // 2
    sets = []
    for _ in range(n_pairs):
        all_of = rng.integers(1, 1 << 63, common + 2 * apart, dtype=np.uint64)
        sets += [all_of[: common + apart], np.concatenate([all_of[:common], all_of[common + apart :]])]
    return near._minwise(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_stay_together_at_every_depth(percent):
    n = 1500
    tokens = sets_alike(n, percent, np.random.default_rng(6))
    first = near._first_nodes(tokens, near.TREES, percent)
    nodes, ids = first.ravel(), np.repeat(np.arange(2 * n), first.shape[1])
    for _ in range(12):
        pair = pa.table({"node": nodes, "pair": ids // 2}).group_by(["node", "pair"]).aggregate([([], "count_all")])
        pair = pair.filter(pa.compute.equal(pair.column("count_all"), 2))
        assert len(set(pair.column("pair").to_pylist())) == n
        paths, left = pair.column("node").to_numpy().view(np.uint64), 2 * pair.column("pair").to_numpy()
        paths, ids = np.concatenate([paths, paths]), np.concatenate([left, left + 1])
        own = ids[:, None], (paths & np.uint64(3)).astype(int)[:, None] * near.SET_COORDINATES + np.arange(near.SET_COORDINATES)
        nodes, rows = near._children(paths, near._sketch(tokens)[own], percent)
        nodes, ids = nodes.view(np.int64), ids[rows]


def test_the_bound_holds_to_the_deepest_level():
    assert all(near.miss_bound(percent, near.LEVELS) < 1e-4 for percent in range(80, 101))


def test_a_large_family_below_the_threshold(table, monkeypatch):
    """3,000 documents of which any two share 0.7 of their shingles, and twenty pairs that share 0.87."""
    common = prose(41, 104)
    rows, own = [], {}
    for d in range(3000):
        words = [f"o{d}x{k}" for k in range(21)]
        if d >= 2980:  # a copy of an earlier one, but for its last words
            words = own[d - 2980][:14] + words[14:]
        own[d] = words
        rows.append((d, " ".join(common + words)))
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    base = set.intersection(*shingles.values())
    holders = defaultdict(list)
    for d, grams in shingles.items():
        for gram in grams - base:
            holders[gram].append(d)
    shared = defaultdict(int)  # of all pairs that share more than the base
    for ids in holders.values():
        for i, x in enumerate(ids):
            for y in ids[:i]:
                shared[y, x] += 1
    sizes = {d: len(g) for d, g in shingles.items()}
    plain = len(base) / (2 * sizes[50] - len(base))
    assert 0.69 < plain < 0.72
    links = [p for p, c in shared.items() if 100 * (c + len(base)) >= 85 * (sizes[p[0]] + sizes[p[1]] - c - len(base))]
    assert sorted(links) == [(d, d + 2980) for d in range(20)]

    confirmed, counts = near._confirmed, []
    monkeypatch.setattr(near, "_confirmed", lambda sets, percent: counts.append(sets.count()) or confirmed(sets, percent))
    monkeypatch.setattr(near, "SMALL_NODE", 256)
    found = {r["id"]: r["component_id"] for r in near.near_duplicates(table(rows)).collect()}
    assert found == {d: d - 2980 if d >= 2980 else d for d in range(3000)}
    assert sum(counts) <= 8 * 3000  # full sets that were sent


def test_repeated_ids_nulls_and_empty_tables(table):
    a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    rows = [(9, a), (9, b), (9, b), (12, b), (4, a), (None, a), (None, None)]
    found = near.near_duplicates(table(rows)).collect()
    assert sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [
        (0, 0, True), (0, 0, True), (4, 4, True), (9, 4, False), (9, 4, False), (9, 4, False), (12, 4, False),
    ]
    assert near.near_duplicates(table([])).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(i + 1, i) for i in range(50, 90)] + [(7, x) for x in range(200, 260)] + [(3, 3), (4, 5), (5, 4)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 50 for i in range(51, 91))
    assert all(found[x] == 7 for x in range(200, 260))
    assert found[5] == 4 and 3 not in found
