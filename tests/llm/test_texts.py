"""Pieces, licenses, fingerprints, tiles and languages against plain Python and the library."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyreel.llm import languages, licenses, merkle, pieces, tiling
from tallyreel.llm.hashing import Words, text_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "",
    " ",
    "  a  b ",
    "▁x ▁▁ y",
    "\n\t 😀 日本語 é <s> <0x0A> </s>",
    "a\0b",
    "x▁",
    "“ﬁ” ½ �",
    " a 　 b c  ",
    "naïve café " * 3000,
    "z" * 4000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_and_spans_equal_the_library(library):
    with open(MODEL, "rb") as file:
        own = pieces.Encoder(file.read())
    for text, (ids, begins, ends) in zip(ODD, own.encode(ODD), strict=True):
        theirs = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in theirs]
        spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
        assert [s for s, p in zip(spans, theirs, strict=True) if not library.is_byte(p.id)] == [
            (p.begin, p.end) for p in theirs if not library.is_byte(p.id)
        ]


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    with open(MODEL, "rb") as file:
        own = pieces.Encoder(file.read())
    assert [own.encode([t])[0][0].tolist() for t in ODD] == library.encode(ODD)


def test_normalising_through_a_compiled_map_equals_the_library():
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = pieces.Normaliser(theirs.serialized_model_proto())
    for text in ODD:
        assert own(text).text == theirs.normalize(text)
        source = own(text).source
        assert (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_encoded_rows(table, library):
    rows = [*enumerate(ODD), (5, None), (5, ODD[2])]
    found = pieces.encode(table([(i, t, "kept") for i, t in rows], "doc_id long, text string, ids string"), MODEL)
    got = sorted((r["id"], r["ids"], r["decoded"], r["rest"]["ids"]) for r in found.collect())
    ids = library.encode([t or "" for _, t in rows])
    assert got == sorted(
        (i, own, text, "kept") for (i, _), own, text in zip(rows, ids, library.decode(ids), strict=True)
    )
    assert pieces.encode(table([]), MODEL).collect() == []


def whole_alignment(template, doc):
    """Longest common subsequence of a template with any stretch of a document."""
    row = [0] * (len(doc) + 1)
    for a in template:
        before = row[:]
        for j, b in enumerate(doc, 1):
            row[j] = before[j - 1] + 1 if a == b else max(before[j], row[j - 1])
    return row[-1]


def test_banded_alignment_equals_a_whole_one_within_its_band():
    rng = random.Random(4)
    for _ in range(60):
        template = [rng.randrange(8) for _ in range(12)]
        doc = [rng.randrange(8, 20) for _ in range(5)] + template[:]
        for _ in range(rng.randrange(4)):
            doc.insert(rng.randrange(5, len(doc)), 99)
        matched, first, end = licenses.align(np.array(template), np.array(doc), 5)
        assert matched == whole_alignment(template, doc) == 12
        assert doc[first] == template[0] and doc[end - 1] == template[-1]


def test_license_notices_and_their_spans(table):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    changed = " ".join("altered" if i in (20, 50) else w for i, w in enumerate(words))
    notice = "Released under the MIT License."
    rows = [
        (1, f"Some text é.\n{notice}\nMore."),
        (2, changed),
        (3, f"{notice} {notice}"),
        (4, "x " * 50_000 + mit),
        (5, None),
        (6, ""),
        (7, "the license is under review and was released under protest"),
        (8, " ".join(words[: len(words) // 3])),
    ]
    found = {
        r["doc_id"]: r["licenses"]
        for r in licenses.scan(table(rows)).select("rest.doc_id", "licenses").collect()
    }
    texts = {i: (t or "").encode() for i, t in rows}
    assert [texts[1][m.begin : m.end] for m in found[1]] == [notice[:-1].encode()]
    assert [(m.license, round(m.coverage, 2)) for m in found[2]] == [("MIT", 0.98)]
    assert [(m.begin, m.license) for m in found[3]] == [(0, "MIT line"), (len(notice) + 1, "MIT line")]
    assert [m.license for m in found[4]] == ["MIT"] and texts[4][found[4][0].begin :].startswith(b"Permission")
    assert found[5] == found[6] == found[7] == found[8] == []
    assert licenses.scan(table([])).collect() == []


def test_sibling_licenses_are_told_apart(table):
    line = "This work is licensed under the GNU {}, version {}."
    header = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
        "published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
        "version."
    )
    names = {
        "GPL-2.0": ("General Public License", "2"),
        "GPL-3.0": ("General Public License", "3"),
        "LGPL-2.0": ("Library General Public License", "2"),
        "LGPL-2.1": ("Lesser General Public License", "2.1"),
        "LGPL-3.0": ("Lesser General Public License", "3"),
        "AGPL-3.0": ("Affero General Public License", "3"),
    }
    cases = [(f"{key} line", line.format(*of)) for key, of in names.items()]
    cases += [(key, header.format(*of)) for key, of in names.items()]
    cases += [(f"CC-{k}-4.0 line", f"Licensed under CC {k} 4.0") for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA")]
    cases += [("LGPL-3.0", header.replace("program", "library").format(*names["LGPL-3.0"]))]
    cases += [(None, "Licensed under CC BY 3.0."), (None, line.format("General Public License", "1"))]
    cases += [(None, "This work is licensed under the new and quite GNU like General Public School License, version 3.")]
    rows = [(i, f"Some words before. {text} And after.") for i, (_, text) in enumerate(cases)]
    found = licenses.scan(table(rows)).select("rest.doc_id", "licenses.license").collect()
    assert {r["doc_id"]: r["license"] for r in found} == {i: [k] if k else [] for i, (k, _) in enumerate(cases)}


def plain_leaves(paragraph):
    return [m[0] for m in re.finditer("[ \t\x0b\f\r]*(?:[^ \t\x0b\f\r]+[ \t\x0b\f\r]*){1,4}|[ \t\x0b\f\r]+", paragraph)]


def plain_root(text):
    def over(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def paragraph(p):
        return over(hashlib.sha256(b.encode()).hexdigest() for b in plain_leaves(p))

    return over(over(paragraph(p) for p in s.split("\n")) for s in text.split("\n\n"))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({l for p in t.split("\n") for l in plain_leaves(p)} for t in (a, b))
    both = sum(map(len, x)) + sum(map(len, y))
    return 2 * sum(map(len, x & y)) / both if both else 0.0


def test_fingerprints_tell_texts_apart_and_edits_are_located(table):
    texts = ["a b c d e\nf g", "a b c d e \nf g", "", "one\n\ntwo\nthree", "one\n \ntwo\nthree", "é" * 9]
    rows = [(10 - i, t) for i, t in enumerate(texts)] + [(None, None), (3, "tie"), (3, "tie")]
    found = merkle.edits(table(rows)).collect()
    assert len(found) == len(rows)
    assert {r["fingerprint"] for r in found} == {plain_root(t or "") for _, t in rows}
    assert len({plain_root(t) for t in texts}) == len(texts)  # blanks in a blank line tell texts apart too
    by_id = {r["id"]: r for r in found if r["id"] is not None and r["id"] != 3}
    third = len(texts[0]) // 3
    changed = texts[0][: len(texts[0]) - third] + texts[1][:third]
    assert by_id[10]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    assert by_id[10]["edited_fingerprint"] == plain_root(changed)
    # Before the end of the first paragraph nothing changes.
    assert by_id[10]["edited_paragraphs"][0] == 1 + (changed.split("\n")[0] == texts[0].split("\n")[0])
    assert by_id[10]["near_edited"] == pytest.approx(plain_likeness(texts[0], changed))
    assert by_id[8]["near_next"] == pytest.approx(plain_likeness(texts[2], texts[3]))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    ties = [r for r in found if r["id"] == 3]
    assert sorted(r["near_next"] for r in ties)[1] == 1.0  # the next row is its copy
    assert merkle.edits(table([])).collect() == []


SPACED = ["", "\n", "\n\n", "\n\n\n", " \n", "\n ", "a\n\nb", "a\n \nb", "a\r\n\r\nb", "a\n\t\nb", "a\n\n\nb", "a \n\nb", "a\n\n b"]


def test_roots_are_equal_exactly_if_texts_are(table):
    rng = random.Random(4)
    texts = sorted({*SPACED, *("".join(rng.choices("a b\n\n\r\té", k=rng.randrange(12))) for _ in range(400))})
    found = merkle.fingerprints(table(list(enumerate(texts * 2)))).collect()
    assert len({r["fingerprint"] for r in found}) == len(texts)
    assert {r["id"]: r["fingerprint"] for r in found} == {i: plain_root(t) for i, t in enumerate(texts * 2)}


def test_an_inserted_word_changes_its_paragraph_only(table):
    rng = random.Random(5)
    paragraphs = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(50)]
    before, after = ("\n\n".join([first + paragraphs[0], *paragraphs[1:]]) for first in ("", "new "))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(100_000))
    rows = {9: before, 8: after, 7: long, 6: long + " end"}
    found = {r["id"]: r["near_next"] for r in merkle.edits(table(list(rows.items()))).collect()}
    assert found[9] > 0.95 and found[7] > 0.99
    assert found == {i: pytest.approx(plain_likeness(rows[i], rows[i - 1 if i > 6 else 9])) for i in rows}


def greedy(doc, item, least=5):
    """Greedy tiles by trying every pair of places for the longest match, again and again."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for d, i in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while (
                d + k < len(doc)
                and i + k < len(item)
                and doc[d + k] == item[i + k]
                and d + k not in used_d
                and i + k not in used_i
            ):
                k += 1
            if k >= least and (best is None or k > best[0]):
                best = (k, d, i)
        if best is None:
            return sorted(tiles)
        k, d, i = best
        used_d |= set(range(d, d + k))
        used_i |= set(range(i, i + k))
        tiles.append((d, i, k))


def test_tiles_equal_greedy_search(table):
    rng = random.Random(3)
    items, docs = [], []
    for n in range(12):
        item = [f"t{rng.randrange(30)}" for _ in range(30)]
        cut = rng.randrange(6, 24)
        moved = item[cut:] + ["x"] + item[:cut]
        noise = [f"n{rng.randrange(50)}" for _ in range(15)]
        items.append((n, " ".join(item)))
        docs.append((n, " ".join([*noise, *(moved if n % 2 else item), *noise]).title()))
    items += [(90, "too few words"), (91, None), (92, items[0][1])]
    docs += [(50, None), (51, ""), (52, items[1][1]), (53, " ".join("abcdefghij"))]
    docs += [(54, ("a a a a a a " * 9).strip())]
    items += [(93, "a a a a a a a")]
    expected = {}
    for d, i in itertools.product(docs, items):
        doc, item = (d[1] or "").lower().split(), (i[1] or "").lower().split()
        tiles = greedy(doc, item) if item else []
        share = sum(t[2] for t in tiles) / max(1, len(item))
        if share >= 0.5:
            expected[d[0], i[0]] = (share, tiles)
    for block_bytes in (4 << 20, 300):  # in one pass over the texts, and in several
        marked = tiling.mark_leaks(table(docs), table(items, "item_id long, text string"), block_bytes=block_bytes)
        found = marked.select("rest.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
        got = {(r["doc_id"], r["item_id"]): (r["coverage"], sorted(map(tuple, r["tiles"]))) for r in found}
        assert got == expected
    assert tiling.mark_leaks(table(docs), table([], "item_id long, text string")).filter("size(matches) > 0").isEmpty()


def test_tiles_of_repetitive_texts_equal_greedy_search():
    rng = random.Random(12)
    for n in range(150):
        item, doc = (rng.choices("ab"[: 1 + n % 2] + "c" * (n % 3 == 0), k=rng.randrange(5, 26)) for _ in range(2))
        other = rng.choices("ab", k=rng.randrange(5, 12))
        seeds = tiling.seeds_of([0, 1], [" ".join(item), " ".join(other)])
        data, offsets = text_bytes(pa.array([" ".join(doc), "", " ".join(other + doc)], pa.string()))
        found = {(t, i): (share, sorted(tiles)) for t, i, share, tiles in tiling._found(seeds, Words(data, offsets), 0.3)}
        expected = {}
        for (t, text), (i, of) in itertools.product([(0, doc), (2, other + doc)], enumerate([item, other])):
            tiles = greedy(text, of)
            share = sum(k for *_, k in tiles) / len(of)
            if share >= 0.3:
                expected[t, i] = (share, tiles)
        assert found == expected


def test_a_very_long_text_of_one_word_takes_little_memory():
    seeds = tiling.seeds_of([7], ["a " * 2_000])
    data, offsets = text_bytes(pa.array(["x y " + "a " * 200_000], pa.string()))
    tracemalloc.start()
    found = list(tiling._found(seeds, Words(data, offsets), 0.5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 7, 1.0, [(2, 0, 2_000)])]
    assert most < 300 << 20


def sentences(seed, letters, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(25)) for _ in range(n)]


def test_languages_are_learned_and_odd_texts_are_not_guessed(table):
    rows = [(t, "xx") for t in sentences(1, "aeioubdk", 120)] + [(t, "yy") for t in sentences(2, "aeiouñßrt", 120)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(rows)]
    docs = table([*rows, (900, None, "xx"), (901, "123 !!", "xx"), (902, "bdk", None), (None, "bdk", "yy")],
                 "doc_id long, text string, lang string")
    model = languages.train_on(docs)
    assert model.languages == ["xx", "yy"] and (model.weights == 0).any()
    assert languages.train_on(docs.repartition(7)).weights.tolist() == model.weights.tolist()
    found = languages.predict(docs, model).select("rest.*", "lang_pred", "score").collect()
    right = [r["lang_pred"] == r["lang"] for r in found if r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(right) == 240 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (900, 901)}
    assert odd == {900: ("und", 0.0), 901: ("und", 0.0)}


def test_without_labels_no_language_is_guessed(table):
    docs = table([(1, "abc", None)], "doc_id long, text string, lang string")
    assert languages.train_on(docs) is None
    assert languages.predict(docs, None).first()["lang_pred"] == "und"
    empty = table([], "doc_id long, text string, lang string")
    assert languages.predict(empty, languages.train_on(empty)).collect() == []


def plain_ftrl(vectors, langs, names, epoch, z, n):
    """One epoch of proximal FTRL, coordinate by coordinate; vectors are (id, {bucket: value})."""
    z, n = [row[:] for row in z], [row[:] for row in n]
    order = sorted(range(len(langs)), key=lambda i: (int(languages_mix(vectors[i][0] + epoch)), vectors[i][0]))
    for i in order:
        x = {**vectors[i][1], languages.BUCKETS: 1.0}
        weights = {}
        for b in x:
            weights[b] = []
            for k in range(len(names)):
                rate = (languages.BETA + math.sqrt(n[b][k])) / languages.ALPHA + languages.L2
                sign = (z[b][k] > 0) - (z[b][k] < 0)
                weights[b].append(0.0 if abs(z[b][k]) <= languages.L1 else (sign * languages.L1 - z[b][k]) / rate)
        scores = [sum(x[b] * weights[b][k] for b in x) for k in range(len(names))]
        powers = [math.exp(s - max(scores)) for s in scores]
        for b in x:
            for k in range(len(names)):
                g = x[b] * (powers[k] / sum(powers) - (names[k] == langs[i]))
                sigma = (math.sqrt(n[b][k] + g * g) - math.sqrt(n[b][k])) / languages.ALPHA
                z[b][k] += g - sigma * weights[b][k]
                n[b][k] += g * g
    return z, n


def languages_mix(value):
    return languages.mix(np.array([value], dtype=np.uint64))[0]


def test_an_epoch_equals_plain_ftrl():
    rng = random.Random(8)
    vectors = [(i, {rng.randrange(30): rng.random() for _ in range(6)}) for i in range(40)]
    langs = [rng.choice("abc") for _ in vectors]
    shape = (languages.BUCKETS + 1, 3)
    z, n = np.zeros(shape), np.zeros(shape)
    plain = z.tolist(), n.tolist()
    for epoch in range(2):
        table = pa.table(
            {
                "id": [i for i, _ in vectors],
                "lang": langs,
                "buckets": [np.array(list(v), dtype=np.int32).tobytes() for _, v in vectors],
                "values": [np.array(list(v.values()), dtype=np.float32).tobytes() for _, v in vectors],
            }
        )
        out = languages._teach(["a", "b", "c"], z, n, epoch)(table)
        z, n = (np.frombuffer(out.column(c)[0].as_py()).reshape(shape) for c in ("z", "n"))
        single = [(i, {b: float(np.float32(x)) for b, x in v.items()}) for i, v in vectors]
        plain = plain_ftrl(single, langs, ["a", "b", "c"], epoch, *plain)
    assert np.allclose(z, plain[0], atol=1e-9) and np.allclose(n, plain[1], atol=1e-9)
    assert np.abs(z).max() > 0.1


def test_the_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) * 4
    logits[np.arange(400), labels] += 3

    def loss(t):
        chance = languages._softmax(logits / t)
        own = np.log(chance[np.arange(400), labels])
        return -(own * (1 - 1 / 402) + np.log(chance).sum(axis=1) / 402 / 3).mean()

    found = languages._temperature(logits, labels)
    assert loss(found) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 601))) + 1e-9


def test_rare_languages_are_learned_from_large_tables(table, monkeypatch):
    monkeypatch.setattr(languages, "FIT_ROWS", 60)
    rng = random.Random(9)
    words = {"xx": ["aba", "bab", "abba"], "yy": ["ogo", "gog", "oggo"], "zz": ["πσω", "ωπσ", "σσπ"]}
    rows = [(i, " ".join(rng.choices(words[l], k=12)), l) for i, l in enumerate(["xx", "yy"] * 1500 + ["zz"] * 3)]
    docs = table(rows, "id long, text string, lang string")
    model = languages.train(docs, 60)
    assert model.languages == ["xx", "yy", "zz"]
    asked = table([(1, " ".join(words["zz"] * 4)), (2, " ".join(words["yy"] * 4))])
    assert [r["lang_pred"] for r in languages.predict(asked, model).orderBy("rest.doc_id").collect()] == ["zz", "yy"]


def test_texts_come_back_with_columns_of_any_name(table):
    docs = table([(1, "abab", "xx", 2.0, "r"), (2, None, "yy", None, None)], "doc_id long, text string, lang string, score double, rest string")
    model = languages.train(docs.select(F.col("doc_id").alias("id"), "text", "lang").dropna())
    back = languages.predict(docs, model).select("rest.*").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, docs.collect()))
    items = table([(1, "one two three four five")], "item_id long, text string")
    back = tiling.mark_leaks(docs, items).select("rest.*").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, docs.collect()))
    alone = docs.select("text")
    assert languages.predict(alone, model).select("rest.text").count() == 2
