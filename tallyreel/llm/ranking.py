"""Ranked lexical search: dense blocks of item weights times document impacts.

A document's impact for a term and an item's weight for it are integers, so a score is an integer
too. Documents are read once and reduced to the terms that some item holds. These sparse rows
meet tiles of items; a tile has a compact vocabulary of its own, in whose columns both sides
are written out as dense float64 blocks and multiplied by BLAS. A vocabulary is cut into parts for
which no sum can reach 2**53, where float64 stops being exact; parts are added as 64-bit integers.

Each block's scores above the tile's last place so far compete for the tile's places, equal scores
by document id, so that ties are kept right whatever the order of the blocks.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.exchange import changes
from tallyreel.llm.hashing import PUNCTUATION, Words, slices, text_bytes

# Ranks that each item gets.
PLACES = 20
# Bytes of item text whose vocabulary is with the tasks at a time; more items take more passes.
GROUP_BYTES = 32 << 20
# Items of one tile, and distinct terms at which a tile of several items ends.
TILE_ITEMS, TILE_TERMS = 256, 1 << 14
# Bytes of tiles that are sent to every task; more of them are joined with the documents instead.
SENT_BYTES = 4 << 20
# Tiles that a task keeps written out, 32 MB each at most.
DENSE_TILES = 4
# Numbers in a dense block of documents.
BLOCK_NUMBERS = 1 << 21
EXACT = 1 << 53
# Fixed values of the score: an impact is UNIT * tf div (1000 * tf + 12 * m), below UNIT div 1000.
UNIT = 1_000_000_000
MOST_IMPACT = UNIT // 1000


class Tile(NamedTuple):
    """Some items: their rows, and the terms of each with its weight times its number in the item."""

    row: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Words, pa.Array]]:
    """Slice by slice: its first text, the places of its terms, and the terms, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    for at, end in slices(offsets):
        words = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], True, PUNCTUATION)
        letters = words.data[~PUNCTUATION[words.data]]
        cuts = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(letters)]
        yield at, words, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), buffers)


def _numbers(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    return pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()


def _counted(text: np.ndarray, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and terms that occur together, by text and term, and how often."""
    keys, counts = np.unique(text.astype(np.int64) * size + term, return_counts=True)
    return keys // size, keys % size, counts


_KINDS = {"docs": np.int64, "lengths": np.int64, "sizes": np.int64, "terms": np.int32, "counts": np.int32}
_PACKED = "docs binary, lengths binary, sizes binary, terms binary, counts binary, n_docs long, n_terms long"


def _pack(vocabulary: pa.Array):
    """Documents as stored rows: those that hold an item's term with these terms; of the others their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            for at, words, terms in _terms(batch.column("text")):
                number, text = _numbers(terms, vocabulary), words.text_of()
                text, term, count = _counted(text[number >= 0], number[number >= 0], max(1, len(vocabulary)))
                # A document without id can't be named; its terms still count, as those of no document do.
                own, sizes = np.unique(text, return_counts=True)
                columns = {
                    "docs": np.where(named[at + own], ids[at + own], 0),
                    "lengths": np.where(named[at + own], words.counts[own], 0),
                    "sizes": sizes,
                    "terms": term,
                    "counts": count,
                }
                made = {n: pa.array([c.astype(_KINDS[n]).tobytes()], pa.binary()) for n, c in columns.items()}
                made["n_docs"] = pa.array([int((words.counts > 0).sum())], pa.int64())
                made["n_terms"] = pa.array([len(words)], pa.int64())
                yield pa.RecordBatch.from_pydict(made)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each term occurs."""
    found = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for terms in batch.column("terms"):
            own = np.bincount(np.frombuffer(terms.as_buffer(), dtype=np.int32))
            longer, shorter = (own, found) if len(own) > len(found) else (found, own)
            found = longer.copy()
            found[: len(shorter)] += shorter
    used = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"term": pa.array(used), "n": pa.array(found[used])})


_TILE = "tile binary"
_FOUND = "row long, doc long, score long"


def _tiles(vocabulary: pa.Array, weights: np.ndarray):
    """Items as tiles of at most TILE_ITEMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, terms in _terms(batch.column("text")):
                item, term, count = _counted(words.text_of(), _numbers(terms, vocabulary), max(1, len(vocabulary)))
                first = np.searchsorted(item, np.arange(len(words.counts) + 1))
                begin = 0
                while begin < len(words.counts):
                    end = min(begin + TILE_ITEMS, len(words.counts))
                    end = max(begin + 1, min(end, int(np.searchsorted(first, first[begin] + TILE_TERMS, "right")) - 1))
                    own = slice(first[begin], first[end])
                    rows = batch.column("row").slice(at + begin, end - begin).to_numpy()
                    tile = Tile(rows, item[own] - begin, term[own], weights[term[own]] * count[own])
                    yield pa.RecordBatch.from_pydict({"tile": pa.array([_written(tile)], pa.binary())})
                    begin = end

    return run


def _written(tile: Tile) -> bytes:
    sizes = np.array([len(c) for c in tile], dtype=np.int64)
    return b"".join(c.astype(np.int64).tobytes() for c in (sizes, *tile))


def _read(data: pa.Buffer) -> Tile:
    numbers = np.frombuffer(data, dtype=np.int64)
    return Tile(*np.split(numbers[4:], np.cumsum(numbers[:3])))


def _parts(weights: np.ndarray) -> list[slice]:
    """Cuts of a vocabulary so that no item's sum over a part can reach EXACT, whatever the impacts."""
    most = np.cumsum(weights.max(axis=0, initial=0))  # of any item, so of every item
    cuts, begin = [], 0
    while begin < weights.shape[1]:
        before = most[begin - 1] if begin else 0
        end = int(np.searchsorted(most, before + (EXACT - 1) // MOST_IMPACT, "right"))
        cuts.append(slice(begin, max(end, begin + 1)))
        begin = cuts[-1].stop
    return cuts


class _Best:
    """The places of a tile's items so far: highest score first, equal scores by document."""

    def __init__(self, items: int, places: int) -> None:
        self.places = places
        self.score = np.zeros((items, places), dtype=np.int64)
        self.doc = np.full((items, places), np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of some documents (items x documents); those that equal the last place compete too."""
        item, at = np.nonzero((scores >= self.score[:, -1:]) & (scores > 0))
        if not len(item):
            return
        old_item, old = np.nonzero(self.score > 0)
        item = np.concatenate([old_item, item])
        score = np.concatenate([self.score[old_item, old], scores[item[len(old) :], at]])
        doc = np.concatenate([self.doc[old_item, old], docs[at]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(changes(item), np.arange(len(item)), 0))
        kept = place < self.places
        self.score[item[kept], place[kept]] = score[kept]
        self.doc[item[kept], place[kept]] = doc[kept]


def _dampings(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents with so many terms."""
    if 25 * n_docs * int(lengths.max(initial=0)) >= 1 << 63:
        lengths = lengths.astype(object)
    return 75 + (25 * n_docs * lengths // max(1, n_terms)).astype(np.int64)


def _product(weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sums of a part: exact in float64, or in integers where one term alone is too heavy for that."""
    if weights.max(axis=0, initial=0).sum() * MOST_IMPACT < EXACT:
        return (weights @ block).astype(np.int64)
    return weights.astype(np.int64) @ block.astype(np.int64)


def _scored(n_docs: int, n_terms: int, places: int, sent: list[bytes] | None):
    """The best documents of a task for each item of its tiles, which come with the rows or were sent to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[Tile, _Best]] = {}
        dense: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # of few tiles, the last ones
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in _KINDS.items()}
                for key in [batch.column("tile")[i].as_py()] if sent is None else sent:
                    if key not in best:
                        tile = _read(key)
                        best[key] = tile, _Best(len(tile.row), places)
                    if key not in dense:
                        dense = dict(list(dense.items())[1 - DENSE_TILES :]) | {key: _written_out(best[key][0])}
                    _offer(row, *dense[key], best[key][1], n_docs, n_terms)
        for tile, found in best.values():
            item, place = np.nonzero(found.score > 0)
            columns = {"row": tile.row[item], "doc": found.doc[item, place], "score": found.score[item, place]}
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})

    return run


def _written_out(tile: Tile) -> tuple[np.ndarray, np.ndarray]:
    """A tile's own vocabulary, and its weights as a dense block (items x terms)."""
    own, column = np.unique(tile.term, return_inverse=True)
    weights = np.zeros((len(tile.row), len(own)))
    weights[tile.item, column] = tile.weight
    return own, weights


def _offer(row: dict, own: np.ndarray, weights: np.ndarray, best: _Best, n_docs: int, n_terms: int) -> None:
    """Score a stored row's documents in dense blocks."""
    doc = np.repeat(np.arange(len(row["sizes"])), row["sizes"])
    column = np.searchsorted(own, row["terms"])
    there = np.zeros(len(column), dtype=bool)
    inside = column < len(own)
    there[inside] = own[column[inside]] == row["terms"][inside]
    there &= row["lengths"][doc] > 0
    doc, column = doc[there], column[there]
    counts = row["counts"][there].astype(np.int64)
    impact = UNIT * counts // (1000 * counts + 12 * _dampings(row["lengths"], n_docs, n_terms)[doc])
    used, doc = np.unique(doc, return_inverse=True)
    parts = _parts(weights)
    step = max(1, BLOCK_NUMBERS // max(1, len(own), len(weights)))
    for at in range(0, len(used), step):
        begin, end = np.searchsorted(doc, [at, at + step])
        block = np.zeros((len(own), min(step, len(used) - at)))
        block[column[begin:end], doc[begin:end] - at] = impact[begin:end]
        scores = np.zeros((len(weights), block.shape[1]), dtype=np.int64)
        for part in parts:
            scores += _product(weights[:, part], block[part])
        best.offer(scores, row["docs"][used[at : at + step]])


def _weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()]
    return np.array(weights, dtype=np.int64)


def _spelt(text: Column) -> Column:
    """All terms of a text, A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))


def rank(docs: DataFrame, items: DataFrame, places: int = PLACES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The best documents of each item: item_id, rank (from 1), doc_id and score.

    ``docs`` has doc_id and text, ``items`` item_id and text. Each row is a document or an item of
    its own, repeated or not. Terms are maximal runs of ASCII letters, digits and characters beyond
    ASCII; null and empty texts have none. Equal scores rank by ascending doc_id. Documents without
    doc_id count in all statistics but are not ranked. Items that share no term with a document, and
    all if a table is empty, have no rows. Other columns are not looked at. A long text is
    counted whole.

    Every group of items with about ``group_bytes`` of text is one pass over the documents; its distinct
    terms and their document counts pass through the driver and are sent to the tasks, and so are its tiles
    if they have SENT_BYTES or less. Otherwise rows of documents meet tiles in a merge join on tile
    and salt, so that no task gets all of either.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    numbered = storage.settle(items.select(F.monotonically_increasing_id().alias("row"), "item_id", text), "items")
    whole = numbered.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = math.ceil(whole / group_bytes)
    found = spark.createDataFrame([], _FOUND)
    for group in range(groups):
        own = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == group)
        # Settled, so that no group's vocabulary outlives its pass.
        found = found.unionByName(storage.settle(_rank_group(docs, own, places), "ranked"))
    order = W.partitionBy("row").orderBy(F.desc("score"), "doc")
    placed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)
    return placed.join(numbered.select("row", "item_id"), "row").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"
    )


def _rank_group(docs: DataFrame, items: DataFrame, places: int) -> DataFrame:
    terms = [r[0] for r in items.select(F.explode(_spelt(F.col("text"))).alias("t")).distinct().collect()]
    vocabulary = pa.array(sorted(t.encode() for t in terms), pa.large_binary())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    packed = storage.settle(texts.mapInArrow(_pack(vocabulary), _PACKED), "packed")
    totals = packed.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    counted = packed.select("terms").mapInArrow(_frequencies, "term long, n long")
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[row["term"]] = row["n"]
    tiles = items.select("row", "text").mapInArrow(_tiles(vocabulary, _weights(frequency, n_docs)), _TILE)
    tiles = storage.settle(tiles, "tiles")
    rows = packed.filter(F.length("docs") > 0).select(*_KINDS)
    sent = None
    if (tiles.agg(F.sum(F.length("tile")).alias("n")).first()["n"] or 0) <= SENT_BYTES:
        sent = [bytes(r["tile"]) for r in tiles.collect()]
    met = _meet(rows, tiles) if sent is None else rows
    return met.mapInArrow(_scored(n_docs, n_terms, places, sent), _FOUND)


def _meet(packed: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every stored row with every tile, by tile bucket and salt.

    There are as many buckets as tiles. A tile is copied to as many salts as tasks can share it;
    the merge join deals both sides out, so nothing is broadcast.
    """
    buckets = max(1, tiles.count())
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(4 * tasks, packed.count()))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    copies = tiles.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)).cast("int"))
    copies = copies.withColumn("salt", each(salts))
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("docs", "terms"), F.lit(salts)).cast("int"))
    dealt = dealt.withColumn("bucket", each(buckets))
    return dealt.join(copies.hint("merge"), ["bucket", "salt"]).drop("bucket", "salt")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
