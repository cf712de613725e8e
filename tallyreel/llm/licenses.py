"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Of every three neighbouring hashes of three words the smallest is a fingerprint, so any five
words that a template and a document share leave a common one. The templates'
fingerprints form an inverted index. Hits in it whose diagonals (place in the document less
place in the template) lie within a band of each other are one candidate, and the template is
aligned with that region of the document. Words that tell sibling licenses apart, and version
numbers, must agree, whatever the coverage.
"""

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm.hashing import PUNCTUATION, Words, slices, text_bytes

GRAM, WINDOW = 3, 3
BAND = 8
COVERAGE = 0.8
# Templates of at most SHORT words need more.
SHORT, SHORT_COVERAGE = 20, 0.9
# Words that a notice must not have beside its template's, and must have if the template has them.
TELLING = (
    "lesser affero sa nd nc sharealike noncommercial noderivatives noderivs advertising acknowledgment "
    "attribution cc0"
).split()
# Versions: a template's must be in the notice.
NUMBERS = [str(n) for n in range(100)]
# The index goes to every task, so templates together may have this many bytes.
MOST_TEMPLATE_BYTES = 8 << 20

def _gnu(name: str, version: str) -> str:
    """The Free Software Foundation's file header."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, or "
        "(at your option) any later version."
    )


def _gnu_line(name: str, version: str) -> str:
    return f"This work is licensed under the GNU {name}, version {version}."


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_GNU = {
    "GPL-2.0": ("General Public License", "2"),
    "GPL-3.0": ("General Public License", "3"),
    "LGPL-2.0": ("Library General Public License", "2"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"),
    "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


# Notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    **{f"{key} line": _gnu_line(*of) for key, of in _GNU.items()},
    **{key: _gnu(*of) for key, of in _GNU.items()},
    **{f"CC-{key}-4.0 line": f"Licensed under CC {key} 4.0." for key in _CC},
    **{
        f"CC-{key}-4.0": f"This work is licensed under a Creative Commons {name} 4.0 International License."
        for key, name in _CC.items()
    },
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": (
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("matched_words", T.LongType()),
            T.StructField("begin", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


class Index(NamedTuple):
    """Templates as word hashes, and their fingerprints sorted with where each comes from."""

    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray
    needed: list[np.ndarray]
    telling: np.ndarray


def _fingerprints(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the winnowed grams and their hashes; the rightmost of equals is chosen."""
    grams = words.runs(GRAM, hashes)
    left = words.left()
    full = left >= GRAM
    chosen = np.zeros(len(words), dtype=bool)
    # A text with fewer grams than a window has one window over what it has.
    for size in range(1, WINDOW + 1):
        whole = np.repeat(words.counts, words.counts)
        if size < WINDOW:
            heads = np.flatnonzero((whole == GRAM + size - 1) & (words.place() == 0))
        else:
            heads = np.flatnonzero(left >= GRAM + WINDOW - 1)
        best = heads.copy()
        for k in range(1, size):
            best = np.where(grams[heads + k] <= grams[best], heads + k, best)
        chosen[best] = True
    at = np.flatnonzero(chosen & full)
    return at, grams[at]


def _hashes_of(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return Words(data, offsets, lower=True, separators=PUNCTUATION).hashes()


def index_of(templates: Mapping[str, str]) -> Index:
    names = sorted(templates)
    data, offsets = text_bytes(pa.array([templates[n] for n in names], pa.string()))
    if len(data) > MOST_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to go to every task")
    words = Words(data, offsets, lower=True, separators=PUNCTUATION)
    hashes = words.hashes()
    at, prints = _fingerprints(words, hashes)
    order = np.argsort(prints, kind="stable")
    own = [hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    telling = _hashes_of(TELLING)
    needed = [np.unique(w[np.isin(w, np.concatenate([telling, _hashes_of(NUMBERS)]))]) for w in own]
    return Index(names, own, prints[order], words.text_of()[at][order], words.place()[at][order], needed, telling)


def _is_notice(index: Index, template: int, matched: int, span: np.ndarray, coverage: float) -> bool:
    """Whether so many equal words in these words of a document are a notice.

    More words than the template has lower the share.
    """
    n = len(index.words[template])
    least = max(coverage, SHORT_COVERAGE) if n <= SHORT else coverage
    if matched < least * max(n, len(span)):
        return False
    others = np.setdiff1d(index.telling, index.needed[template])
    return bool(np.isin(index.needed[template], span).all()) and not np.isin(others, span).any()




def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best banded alignment: matched words, first word and last-plus-one word in the document.

    Both texts may have words that the other lacks; only equal words count.

    Word i of the template may match words ``i + shift - band`` to ``i + shift + band`` of the
    document. Of equally good alignments the one that spans fewest words, then the leftmost, counts.
    """
    # A state is (matched words, first word, last-plus-one word) of the best alignment so far.
    nothing = (0, 0, 0)
    above = [nothing] * (2 * band + 1)
    for i in range(len(template)):
        row, left = [], nothing
        for k in range(2 * band + 1):
            j = i + shift - band + k
            # Without word i of the template, or without word j of the document.
            best = above[k + 1] if k < 2 * band else nothing
            if _better(left, best):
                best = left
            if 0 <= j < len(doc) and doc[j] == template[i]:
                before = above[k]
                taken = (before[0] + 1, before[1] if before[0] else j, j + 1)
                if _better(taken, best):
                    best = taken
            row.append(best)
            left = best
        above = row
    best = nothing
    for state in above:
        if _better(state, best):
            best = state
    return best


def _better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    return (a[0], b[2] - b[1], -a[1]) > (b[0], a[2] - a[1], -b[1])


def _scan_slice(index: Index, words: Words, coverage: float) -> Iterator[tuple[int, dict]]:
    hashes = words.hashes()
    at, prints = _fingerprints(words, hashes)
    low = np.searchsorted(index.prints, prints, side="left")
    high = np.searchsorted(index.prints, prints, side="right")
    hits = np.flatnonzero(high > low)
    candidates = set()
    for h in hits.tolist():
        text = int(np.searchsorted(words.bounds, at[h], side="right")) - 1
        place = int(at[h] - words.bounds[text])
        for entry in range(low[h], high[h]):
            candidates.add((text, int(index.template[entry]), place - int(index.place[entry]), place))
    found: dict[int, list[tuple]] = {}
    last, missed, doc = None, 0, hashes
    for text, template, diagonal, place in sorted(candidates):
        if (text, template) != last:
            last, missed = (text, template), diagonal - BAND
            doc = hashes[words.bounds[text] : words.bounds[text + 1]].copy()
        # Words of a notice that was found, and diagonals where none was, are not tried again.
        if not doc[place] or diagonal - missed <= BAND // 2:
            continue
        matched, first, end = align(index.words[template], doc, diagonal)
        share = matched / len(index.words[template])
        if _is_notice(index, template, matched, doc[first:end], coverage):
            found.setdefault(text, []).append((-matched, -share, first, end, index.names[template]))
            doc[first:end] = 0
        else:
            missed = diagonal
    for text, matches in found.items():
        taken: list[tuple[int, int]] = []
        for matched, share, first, end, name in sorted(matches):
            if all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                begin = words.bounds[text] + first
                yield text, {
                    "license": name,
                    "coverage": -share,
                    "matched_words": -matched,
                    "begin": int(words.starts[begin]),
                    "end": int(words.ends[words.bounds[text] + end - 1]),
                }


def _scan(index: Index, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [
                    ("license", pa.string()),
                    ("coverage", pa.float64()),
                    ("matched_words", pa.int64()),
                    ("begin", pa.int64()),
                    ("end", pa.int64()),
                ]
            )
        )
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                words = Words(data[offsets[a] : offsets[b]], own, lower=True, separators=PUNCTUATION)
                for text, match in _scan_slice(index, words, coverage):
                    match["begin"] -= int(own[text])
                    match["end"] -= int(own[text])
                    found[a + text].append(match)
            yield pa.RecordBatch.from_pydict({"rest": batch.column("rest"), "licenses": pa.array(found, kind)})

    return run


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    text_column: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """License notices in each document: ``rest`` (the struct of all columns) and ``licenses``.

    Words are runs of letters and digits, A-Z lower-cased. A notice has the template's name, the
    share of its words that the alignment matched (at least ``coverage``, also of the words it spans; more
    for short templates), how many those are, and the bytes it spans in the document. Its TELLING words
    and version numbers are the template's. Where notices overlap, the one with the most matched
    words, then the higher share, then the one further left, then the name counts. Templates under five
    words are found only if three words in a row are in the document. Null or empty texts
    have no notice; repeated rows get equal answers. No document moves.
    """
    rows = docs.select(
        F.col(f"`{text_column}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    )
    schema = T.StructType([T.StructField("rest", docs.schema), T.StructField("licenses", FOUND)])
    return rows.mapInArrow(_scan(index_of(templates), coverage), schema)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per notice in a document: the license, matched coverage and the bytes it spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select(F.col("rest.doc_id").alias("doc_id"), F.explode("licenses").alias("l"))
    return found.select("doc_id", "l.license", "l.coverage", "l.matched_words", "l.begin", "l.end")
