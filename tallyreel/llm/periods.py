"""Periodic runs of words: seed and extend along diagonals.

A stretch of words has period ``q`` if words ``q`` apart are equal; written against itself ``q``
words later, it is a match on the diagonal of lag ``q``. A run of period ``q`` and ``max(12, 2q)``
words or more matches over ``max(12 - q, q)`` words at least, so

* every run has two equal 6-grams ``q`` apart (6 is the least of ``max(12 - q, q)``), and
* from 12 on, a run with a period in ``[k, 2k)`` has two equal k-grams ``q`` apart.

The index therefore has grams of 6, 12, 24, ... words, each made from two of half the size, as long
as some repeat inside a document. Lags of one size class are looked for among the occurrences of
its grams. Occurrences of a gram at most half its size apart can only form an arithmetic
progression (its own period), so they are kept as one cluster; two clusters of a gram meet on one
diagonal for each distinct lag, and within a class a cluster has three partners at most. So the
diagonals tried stay in proportion to the words of a class, also where one word fills a text.

Diagonals are extended by the gram index itself, largest grams first. Per lag, the furthest place
that an extension has covered suppresses later seeds of the same diagonal.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.exchange import changes
from tallyreel.llm.hashing import SEPARATORS, Words, slices, text_bytes

LEAST_WORDS = 12
# The least match of a run with itself, over all periods.
SEED = LEAST_WORDS // 2
SPACE = 0x20
RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


class Runs(NamedTuple):
    """Runs by start, then period; starts count from the first word of a slice."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _numbered(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For all n places: equal numbers where keys are equal, elsewhere a number that no other has."""
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(changes(keys[order])) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    out = -1 - np.arange(n, dtype=np.int64)
    out[at[order[many]]] = group[many]
    return out.astype(np.int32) if n < 1 << 31 else out


def _joined(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the grams that are one gram of ``size`` words and one behind it."""
    n = len(first)
    at = np.flatnonzero(first[: max(0, n - size)] >= 0)
    at = at[second[at + size] >= 0]
    return _numbered(first[at].astype(np.int64) * n + second[at + size], at, n)


def _index(words: np.ndarray) -> dict[int, np.ndarray]:
    """Gram numbers by size: 1, 2, 3, 6, 12, ... as long as a gram repeats."""
    grams = {1: _numbered(words, np.arange(len(words)), len(words))}
    grams[2] = _joined(grams[1], grams[1], 1)
    grams[3] = _joined(grams[2], grams[1], 2)
    size = 3
    while (grams[size] >= 0).any():
        grams[2 * size] = _joined(grams[size], grams[size], size)
        size *= 2
    return grams


def _forward(grams: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on; a < b."""
    length = np.zeros(len(a), dtype=np.int64)
    for size in sorted(grams, reverse=True):
        rank, there = grams[size], b + length
        inside = there < len(rank)
        there = np.where(inside, there, 0)
        length += size * (inside & (rank[np.where(inside, a + length, 1)] == rank[there]))
    return length


def _backward(grams: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b; a < b."""
    length = np.zeros(len(a), dtype=np.int64)
    for size in sorted(grams, reverse=True):
        rank, here = grams[size], a - length - size
        inside = here >= 0
        same = rank[np.where(inside, here, 0)] == rank[np.where(inside, b - length - size, 1)]
        length += size * (inside & same)
    return length


def _seeds(rank: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags in [low, high) of equal grams: one for each diagonal of two clusters."""
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    if not len(at):
        return at, at
    new = changes(rank[at])
    new[1:] |= np.diff(at) > size // 2
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    begin, last = at[head], at[head + count - 1]
    step = np.where(count > 1, at[np.minimum(head + 1, len(at) - 1)] - begin, 0)
    gram = rank[begin]
    # Inside a cluster all lags are multiples of its step, so no other is a smallest period.
    own = (count > 1) & (step >= low) & (step < high)
    places, lags = [begin[own]], [step[own]]
    for further in range(1, len(head)):
        near = (gram[further:] == gram[:-further]) & (begin[further:] - last[:-further] < high)
        x = np.flatnonzero(near)
        if not len(x):
            break
        y = x + further
        each = np.maximum(np.maximum(step[x], step[y]), 1)
        base = begin[y] - begin[x]
        least = np.maximum(1 - count[x], -((base - low) // each))
        most = np.minimum(count[y] - 1, (high - 1 - base) // each)
        number = np.maximum(most - least + 1, 0)
        pair = np.repeat(np.arange(len(x)), number)
        turn = least[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
        places.append(begin[x][pair] + np.maximum(-turn, 0) * each[pair])
        lags.append(base[pair] + turn * each[pair])
    return np.concatenate(places), np.concatenate(lags)


def runs_of(words: np.ndarray) -> Runs:
    """All runs in word numbers; words of different documents must have different numbers."""
    grams = _index(words)
    n = len(words)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for size in (s for s in grams if s >= SEED):
        place, lag = _seeds(grams[size], size, 1 if size == SEED else size, 2 * size)
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        head = changes(lag)
        head[1:] |= np.diff(place) > size  # else its gram touches the one before on the same diagonal
        place, lag = place[head], lag[head]
        end = place + _forward(grams, place, place + lag)
        covered = np.maximum.accumulate(lag * (n + 1) + end)
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = covered[:-1] <= lag[1:] * (n + 1) + place[1:]
        place, lag, end = place[fresh], lag[fresh], end[fresh]
        begin = place - _backward(grams, place, place + lag)
        length = end - begin + lag
        long = (end - begin >= lag) & (length >= LEAST_WORDS)
        found.append(np.column_stack([begin, length, lag])[long])
    rows = np.concatenate(found)
    # A stretch with several periods is a run of the smallest.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[changes(rows[:, 0], rows[:, 1])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1], rows[:, 2])


def _texts(words: Words, kept: np.ndarray, letters: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    length = np.where(kept, words.ends - words.starts, 0)
    text = words.text_of()[kept]
    spaced = ~changes(text[::-1])[::-1]  # a word behind which another of its text is kept
    data = letters[np.repeat(kept, words.ends - words.starts)]
    data = np.insert(data, np.cumsum(length[kept])[spaced], SPACE)
    sizes = np.bincount(text, length[kept], len(words.counts)) + np.bincount(text, spaced, len(words.counts))
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    whole = pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(offsets), pa.py_buffer(data))
    return whole.cast(pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for at, end in slices(offsets):
            part, bounds = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            words = Words(part, bounds)
            letters = part[~SEPARATORS[part]]
            cuts = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
            spelt = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]
            ).dictionary_encode()
            text = words.text_of()
            runs = runs_of(text * max(1, len(spelt.dictionary)) + spelt.indices.to_numpy())
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, runs.start + runs.period, 1)
            np.add.at(change, runs.start + runs.length, -1)
            kept = np.cumsum(change[:-1]) == 0
            own = text[runs.start]
            place = pa.StructArray.from_arrays(
                [pa.array(runs.start - words.bounds[own]), pa.array(runs.length), pa.array(runs.period)],
                fields=[pa.field(n, pa.int64(), False) for n in Runs._fields],
            )
            ends = np.searchsorted(own, np.arange(end - at + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "rest": batch.column("rest").slice(at, end - at),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "runs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), place),
                    "collapsed": _texts(words, kept, letters),
                }
            )


def periodic_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Per row: ``rest`` (the struct of its other columns), n_words, ``runs`` and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of at least 12 words and two periods that
    no neighbouring word extends, with its smallest period; runs are ordered by start, then
    period, and count words from 0. ``collapsed`` has the words that no run contains after its
    first period, joined by one space. Null, empty and blank texts have no words and no runs. Rows
    stay as they are, repeated ones included; an empty table gives an empty one. A text is worked
    on whole: some 4 bytes a word for each doubling of its longest repeated stretch.
    """
    rows = docs.select(F.col(f"`{text_column}`").alias("text"), storage.others(docs, text_column).alias("rest"))
    schema = T.StructType(
        [
            rows.schema["rest"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", RUNS),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return rows.mapInArrow(_find, schema)


def with_planted_tail(docs: DataFrame) -> DataFrame:
    """docs with ``text`` changed to a periodic tail in a tenth of the documents, as the query asks.

    Let h be the crc32 of the doc_id as text and g = h div 10. If h mod 10 is 0, the words
    from a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words at a. A null doc_id
    or a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a, p = F.col("_n"), F.col("_a"), F.col("_p")
    words = F.col("_words")
    g = F.floor(h / 10).cast("long")
    counted = docs.withColumn("_words", F.when(chosen, split)).withColumn("_n", F.size("_words").cast("long"))
    placed = counted.withColumn("_a", F.when(n > 0, F.pmod(g, n)))
    placed = placed.withColumn("_p", F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times)), 1, (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return placed.withColumn("text", F.coalesce(F.when(n > 0, made), F.col("text"))).select(*docs.columns)


def _lines(runs: Column) -> Column:
    made = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(made, "")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: its number of runs, the longest of them, and digests of all runs and of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_tail(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    named = found.withColumn("best", best.cast("struct<length: long, start: long, period: long>"))
    return named.select(
        F.col("rest.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
