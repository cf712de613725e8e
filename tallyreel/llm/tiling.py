"""Benchmark decontamination by greedy string tiling.

Hashes of five words, rolled over both texts (Karp-Rabin), are the seeds: a document and a
benchmark item that share some are compared. Seeds that follow one another in both
texts are joined to matches. The longest match is marked as a tile, what it overlaps is cut
back to its unmarked parts, and so on until no match of five words is left. The share of an
item's words under tiles is its coverage, in whatever order the tiles lie, so passages
whose sentences were moved about are caught as well.
"""

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.hashing import Words, slices, text_bytes

TILE_WORDS = 5
COVERAGE = 0.5
# Benchmark bytes that go to the tasks at once; a larger benchmark is compared block by block.
BLOCK_BYTES = 4 << 20

_TILE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("doc_word", "item_word", "words")])
MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("tiles", T.ArrayType(_TILE)),
        ]
    )
)


class Ends(NamedTuple):
    """Seeds grouped by hash and, within it, by the six-word hash that goes one word further to one side."""

    seed: np.ndarray  # the seeds in this order
    further: np.ndarray  # the six-word hashes, sorted
    begin: np.ndarray  # where the seeds of each stand
    end: np.ndarray


class Seeds(NamedTuple):
    """All five-word hashes of a block of items, sorted."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    first: Ends  # by the word before
    last: Ends  # by the word after


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Five-word hashes, then the six-word ones from a word earlier and from the same word, each with where it exists."""
    single, left = words.hashes(), words.left()
    longer = words.runs(TILE_WORDS + 1, single)
    earlier = np.concatenate([longer[:1], longer[:-1]])
    has_earlier = (words.place() > 0) & (left >= TILE_WORDS)
    return words.runs(TILE_WORDS, single), earlier, has_earlier, longer, left > TILE_WORDS


def _ends(hashes: np.ndarray, further: np.ndarray, exists: np.ndarray) -> Ends:
    seed = np.lexsort((further, exists, hashes))
    hashes, further, exists = hashes[seed], further[seed], exists[seed]
    changes = (np.diff(hashes) != 0) | (np.diff(further) != 0) | (exists[1:] != exists[:-1])
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(seed)), bool), changes]))
    end = np.append(begin[1:], len(seed))
    known = exists[begin]
    begin, end = begin[known], end[known]
    order = np.argsort(further[begin], kind="stable")
    return Ends(seed, further[begin][order], begin[order], end[order])


def seeds_of(ids: list[int], texts: list[str]) -> Seeds:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = Words(data, offsets, lower=True)
    full = np.flatnonzero(words.left() >= TILE_WORDS)
    hashes, earlier, has_earlier, longer, has_longer = (column[full] for column in _hashes(words))
    order = np.argsort(hashes, kind="stable")
    return Seeds(
        hashes[order],
        words.text_of()[full],
        words.place()[full],
        np.array(ids, dtype=np.int64),
        words.counts,
        _ends(hashes, earlier, has_earlier),
        _ends(hashes, longer, has_longer),
    )


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, position) of every position in ranges."""
    times = np.maximum(end - begin, 0)
    number = np.repeat(np.arange(len(begin)), times)
    before = np.cumsum(times) - times
    return number, begin[number] + np.arange(len(number)) - before[number]


def _unextended(ends: Ends, low: np.ndarray, high: np.ndarray, further: np.ndarray, exists: np.ndarray):
    """(number of the hit, seed) of the seed pairs whose match goes no further to this side."""
    if len(ends.further):
        at = np.minimum(np.searchsorted(ends.further, further), len(ends.further) - 1)
        same = exists & (ends.further[at] == further)
        begin, end = np.where(same, ends.begin[at], low), np.where(same, ends.end[at], low)
    else:
        begin = end = low
    parts = [_expand(low, begin), _expand(end, high)]
    hit, position = (np.concatenate(p) for p in zip(*parts, strict=True))
    return hit, ends.seed[position]


def tiles_of(doc: np.ndarray, item: np.ndarray, size: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal matches: (word of the document, word of the item, words).

    Of equally long matches the one earlier in the document, then in the item, is marked.
    """
    matches = list(zip((-size).tolist(), doc.tolist(), item.tolist(), strict=True))
    heapq.heapify(matches)
    start = int(doc.min())
    marked_doc = np.zeros(int((doc + size).max()) - start, dtype=bool)
    marked_item = np.zeros(int((item + size).max()), dtype=bool)
    tiles = []
    while matches:
        size, d, i = heapq.heappop(matches)
        size = -size
        taken = marked_doc[d - start : d - start + size] | marked_item[i : i + size]
        if not taken.any():
            tiles.append((d, i, size))
            marked_doc[d - start : d - start + size] = marked_item[i : i + size] = True
            stops = np.flatnonzero(np.concatenate([[True], marked_item, [True]]))
            if np.diff(stops).max() <= least:  # no match fits between marked words of the item
                break
            continue
        stops = np.flatnonzero(np.concatenate([[True], taken, [True]]))
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            if b - a > least:
                heapq.heappush(matches, (-(b - a - 1), d + a, i + a))
    return tiles


def _found(seeds: Seeds, words: Words, coverage: float) -> Iterator[tuple[int, int, float, list]]:
    """(text, item, coverage, tiles) of all pairs in a slice that reach the coverage.

    Only the two ends of each maximal match are made, not the seeds in between, so a text that repeats a word
    costs its words plus the item's, not their product. On a diagonal of a pair the first ends and the
    last ends alternate, so in that order the n-th of the one belongs to the n-th of the other.
    """
    hashes, earlier, has_earlier, longer, has_longer = _hashes(words)
    low = np.searchsorted(seeds.hashes, hashes, side="left")
    high = np.searchsorted(seeds.hashes, hashes, side="right")
    hits = np.flatnonzero((words.left() >= TILE_WORDS) & (high > low))
    if not len(hits):
        return
    text_of, place_of = words.text_of()[hits], words.place()[hits]

    def sorted_ends(ends: Ends, further: np.ndarray, exists: np.ndarray) -> tuple[np.ndarray, ...]:
        hit, seed = _unextended(ends, low[hits], high[hits], further[hits], exists[hits])
        text, item, where, place = text_of[hit], seeds.item[seed], place_of[hit], seeds.place[seed]
        order = np.lexsort((where, where - place, item, text))
        return text[order], item[order], where[order], place[order]

    text, item, where, place = sorted_ends(seeds.first, earlier, has_earlier)
    size = sorted_ends(seeds.last, longer, has_longer)[2] - where + TILE_WORDS
    pair = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0)]))
    for a, b in zip(pair, np.append(pair[1:], len(text)), strict=True):
        n = int(seeds.words[item[a]])
        begin, end = place[a:b], place[a:b] + size[a:b]
        depth = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        if (np.cumsum(depth) > 0).sum() < coverage * n:  # tiles can't cover more than all matches do
            continue
        tiles = tiles_of(where[a:b], place[a:b], size[a:b])
        share = sum(t[2] for t in tiles) / n
        if share >= coverage:
            yield int(text[a]), int(seeds.ids[item[a]]), share, tiles


def _mark(seeds: Seeds, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found: list[list[dict]] = batch.column("matches").to_pylist()
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                for text, item, share, tiles in _found(seeds, words, coverage):
                    places = [dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in tiles]
                    found[a + text].append({"item_id": item, "coverage": share, "tiles": places})
            kind = kind or batch.schema.field("matches").type
            columns = [pa.array(found, kind) if c == "matches" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Benchmark items that each document holds: ``rest`` (the struct of all columns) and ``matches``.

    ``benchmark`` has item_id and text. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
    A match lists the item, its coverage (at least ``coverage``) and the tiles, in words. Items
    with fewer than five words, or null, match nothing, as do null texts. Repeated items are
    matched each. No document moves: the benchmark goes to the tasks in blocks of
    ``block_bytes``, one pass over the texts for each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    whole = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = math.ceil(whole / block_bytes)
    rows = docs.select(
        F.col(f"`{text_column}`").alias("text"),
        storage.others(docs, text_column).alias("rest"),  # each text goes to a task once
        F.array().cast(MATCHES).alias("matches"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        own = own.collect()
        if own:
            seeds = seeds_of([r["item_id"] for r in own], [r["text"] for r in own])
            rows = rows.mapInArrow(_mark(seeds, coverage), schema)
    back = {c: F.col("text") if c == text_column else F.col(f"rest.`{c}`") for c in docs.columns}
    return rows.select(F.struct(*[value.alias(c) for c, value in back.items()]).alias("rest"), "matches")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that it holds: how much of the item, in how many tiles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = mark_leaks(docs, benchmark).select(F.col("rest.doc_id").alias("doc_id"), F.explode("matches").alias("m"))
    return found.select(
        "doc_id",
        "m.item_id",
        "m.coverage",
        F.size("m.tiles").cast("long").alias("n_tiles"),
        F.array_max("m.tiles.words").cast("long").alias("longest_tile"),
    )
