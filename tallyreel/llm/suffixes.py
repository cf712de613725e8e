"""Removal of byte strings that an earlier document already holds (bucket-pointer refinement).

Suffixes are sorted into buckets that are refined round by round, as in a suffix array
built with bucket pointers. A suffix's first bucket is that of its leading 16-gram. The
bucket at depth 32 is named by the pointers at offsets 0 and 16, the one at depth 50 by
the depth-32 pointers at offsets 0 and 18: each depth reuses the pointers updated at the
one before. Between depths the buckets are sorted over the whole corpus, and suffixes
whose bucket lies within one document leave.

Only sampled suffixes enter the first sort: of the 35 16-grams in a 50-byte string the one
with the smallest hash, the leftmost of equals. The choice hangs on the string alone, so
equal strings meet in one bucket. A sampled suffix stands for the run of neighbouring
strings that chose it. The second sort compares whole runs (the depth-50 pointers of
their first and last string, which cover them). Around the sampled gram a string has 17 more
bytes to the left or to the right, so two different runs of a bucket can hold an equal
string only if the 33 bytes up to the gram's end or from its start are equal. Only the
halves of runs for which that is so are sorted string by string, in the last round.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import exchange, storage
from tallyreel.llm.hashing import byte_sums, mix, slices, spans, text_bytes, windows

MATCH_BYTES = 50
GRAM = 16
GRAMS = MATCH_BYTES - GRAM + 1
LAST_ID = (1 << 63) - 1

SIDE = (MATCH_BYTES - GRAM) // 2  # bytes beyond the gram that a string has on one side

RUN = np.dtype([("k", "<u8"), ("g", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("left", "<u4"), ("right", "<u4")])
# What a bucket says of a run: an earlier document outside the chunk holds it, or the
# halves that another run may share. 96 bits name the run among those of a chunk.
SAID = np.dtype([("k", "<u8"), ("h", "<u4"), ("said", "u1")])
OLD, LEFT, RIGHT = 1, 2, 4
# Kinds of answers: of runs, of strings, and what a chunk said to itself; negative ones name a bucket.
RUNS, STRINGS, OWN = 2, 3, 4
OLD_STRING = np.dtype([("k", "<u8"), ("h", "<u4")])


class Runs(NamedTuple):
    """The sampled suffixes of some texts and the strings each stands for."""

    key: np.ndarray  # bucket of the sampled suffix
    at: np.ndarray  # its offset
    low: np.ndarray  # first string of the run
    high: np.ndarray  # last string of the run
    text: np.ndarray  # number of the text


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the order in which every round sees them."""
    rows = table.column("row").to_numpy()
    return table if (rows[1:] > rows[:-1]).all() else table.take(pa.array(np.argsort(rows)))


def _slices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]]:
    data, offsets = text_bytes(table.column("text"))
    ids = table.column("id").fill_null(LAST_ID).to_numpy()
    for a, b in slices(offsets):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], (a, b)


def _minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each window of a size, by doubling."""
    out, width = values, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _grams(data: np.ndarray, family: int) -> np.ndarray:
    """Depth-16 pointers of all suffixes."""
    return mix(windows(byte_sums(data, family), GRAM, family))


def _runs(grams: np.ndarray, offsets: np.ndarray) -> Runs:
    n = int(offsets[-1])
    empty = np.zeros(0, dtype=np.int64)
    if n < MATCH_BYTES:
        return Runs(np.zeros(0, dtype=np.uint64), empty, empty, empty, empty)
    # The upper half of the hash orders; the offset below it finds the leftmost smallest.
    order = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_minimum(order, GRAMS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    inside = np.arange(len(chosen)) + MATCH_BYTES <= offsets[1:][text]
    low = np.flatnonzero(inside & exchange.changes(chosen, text))
    # A run ends where the next begins or at the last string of its text.
    ends = np.empty(len(low), dtype=np.int64)
    ends[:-1] = low[1:] - 1
    ends[-1:] = len(chosen) - 1
    high = np.minimum(ends, offsets[1:][text[low]] - MATCH_BYTES)
    at = chosen[low]
    # Chosen hashes are small ones; mixed anew, they spread evenly over the buckets.
    return Runs(mix(grams[at]), at, low, high, text[low])


def _refine(pointers: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The next depth's pointers from those at an offset and at a later one."""
    return mix(mix(pointers) * np.uint64(3) + others)


def _strings(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Depth-50 pointers of the suffixes at the given offsets."""

    def half(p: np.ndarray) -> np.ndarray:
        return _refine(grams[p], grams[p + GRAM])

    return _refine(half(at), half(at + MATCH_BYTES - 2 * GRAM))


def _run_names(grams: np.ndarray, sums: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per run: the pointers of its first and last string, and another hash of its bytes."""
    shape = ((runs.at - runs.low) * MATCH_BYTES + (runs.high - runs.low)).astype(np.uint64)
    pointers = _refine(_refine(_strings(grams, runs.low), _strings(grams, runs.high)), shape)
    return pointers, _refine(spans(sums, runs.low, runs.high + MATCH_BYTES, 1), shape)


def _send_suffixes(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for data, offsets, ids, _ in _slices(table):
            runs = _runs(_grams(data, 0), offsets)
            keys.append(runs.key)
            docs.append(ids[runs.text])
        return exchange.send_short(np.concatenate(keys), np.concatenate(docs), exchange.chunk_of(table), buckets)

    return run


def _sides(sums: np.ndarray, offsets: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 33 bytes up to the end of each sampled gram and from its start; 0 where cut short."""
    begin, end = offsets[:-1][runs.text], offsets[1:][runs.text]
    low, high = runs.at - SIDE, runs.at + GRAM + SIDE
    left = mix(spans(sums, np.maximum(low, 0), runs.at + GRAM, 1))
    right = mix(spans(sums, runs.at, np.minimum(high, len(sums) - 1), 1))
    return np.where(low >= begin, left, 0).astype(np.uint32), np.where(high <= end, right, 0).astype(np.uint32)


class Part(NamedTuple):
    """A slice of a chunk, with its runs and those whose bucket is shared."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    rows: tuple[int, int]
    runs: Runs
    shared: np.ndarray


def _parts(table: pa.Table, shared: np.ndarray, buckets: int, sides: bool) -> Iterator[tuple[Part, np.ndarray]]:
    """Slices of a chunk with the records of their shared runs."""
    for data, offsets, ids, rows in _slices(table):
        grams = _grams(data, 0)
        runs = _runs(grams, offsets)
        keep = np.flatnonzero(exchange.contains(shared, exchange.short(runs.key, buckets)))
        own = Runs(*(c[keep] for c in runs))
        records = np.empty(len(keep), dtype=RUN)
        if len(keep):
            sums = byte_sums(data, 1)
            records["g"], records["h"] = _run_names(grams, sums, own)
            records["k"], records["doc"] = own.key, ids[own.text]
            if sides:
                records["left"], records["right"] = _sides(sums, offsets, own)
        yield Part(data, offsets, ids, rows, runs, keep), records


def _combine_runs(records: np.ndarray) -> np.ndarray:
    records = records[np.lexsort((records["doc"], records["h"], records["g"], records["k"]))]
    return records[exchange.changes(records["k"], records["g"], records["h"])]


def _send_runs(buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return exchange.send(np.zeros(0, dtype=RUN), 0, buckets)
        parts = _parts(_in_order(table), exchange.short_answers(told), buckets, True)
        found = [np.zeros(0, dtype=RUN), *(records for _, records in parts)]
        return exchange.send(_combine_runs(np.concatenate(found)), exchange.chunk_of(table), buckets)

    return run


def _elsewhere(bucket: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which of different runs have a side that another run of their bucket has too."""
    order = np.lexsort((side, bucket))
    group = np.cumsum(exchange.changes(bucket[order], side[order])) - 1
    out = np.zeros(len(side), dtype=bool)
    out[order] = np.bincount(group)[group] > 1 if len(group) else False
    return out & (side != 0)


def _sort_runs(table: pa.Table) -> pa.Table:
    """What a bucket says of the runs it was sent, to each chunk that needs to know."""
    records, chunks = exchange.received(table, RUN)
    order = np.lexsort((records["doc"], records["h"], records["g"], records["k"]))
    records, chunks = records[order], chunks[order]
    bucket = np.cumsum(exchange.changes(records["k"])) - 1
    first = exchange.changes(records["k"], records["g"], records["h"])
    run = np.cumsum(first) - 1
    own = records[first]
    said = _elsewhere(bucket[first], own["left"]) * LEFT + _elsewhere(bucket[first], own["right"]) * RIGHT
    out = np.empty(len(records), dtype=SAID)
    out["k"], out["h"] = records["g"], records["h"] & np.uint64(0xFFFFFFFF)
    # Only the smallest document's run is taken apart; the others are old as a whole.
    out["said"] = np.where(own["doc"][run] < records["doc"], OLD, said[run])
    keep = out["said"] > 0
    return exchange.answer(out[keep], chunks[keep], RUNS)


def _judge(told: pa.Table, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's runs, which an earlier document holds, and what is said of the others."""
    answers = exchange.answers(told, RUNS, SAID)
    answers = answers[np.lexsort((answers["h"], answers["k"]))]
    place = exchange.lookup(answers, records["g"], records["h"] & np.uint64(0xFFFFFFFF))
    said = np.zeros(len(records), dtype=np.uint8)
    said[place >= 0] = answers["said"][place[place >= 0]]
    names = np.empty(len(records), dtype=exchange.FIRST)
    names["k"], names["h"], names["doc"] = records["g"], records["h"], records["doc"]
    firsts = exchange.combine_firsts(names)
    first = firsts["doc"][exchange.lookup(firsts, records["g"], records["h"])]
    old = (said == OLD) | (first < records["doc"])
    return old, np.where(old, 0, said)


def _spread_out(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All offsets from low to high, and the number of the range of each."""
    sizes = np.maximum(high - low + 1, 0)
    begin = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(sizes)), sizes)
    return low[number] + np.arange(len(number)) - np.repeat(begin, sizes), number


def _apart(part: Part, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and records of the strings of the halves of a slice's runs that must be taken apart."""
    runs = part.runs
    # A string of the left half begins 17 bytes or more before the sampled gram.
    low = np.where(said & LEFT, runs.low, np.maximum(runs.low, runs.at - SIDE + 1))
    high = np.where(said & RIGHT, runs.high, np.minimum(runs.high, runs.at - SIDE))
    at, run = _spread_out(low, np.where(said & (LEFT | RIGHT), high, low - 1))
    found = np.empty(len(at), dtype=exchange.FIRST)
    if len(at):  # pointers are made anew; those of a whole chunk would fill the memory
        found["k"] = _strings(_grams(part.data, 0), at)
        found["h"] = mix(spans(byte_sums(part.data, 1), at, at + MATCH_BYTES, 1))
        found["doc"] = part.ids[runs.text[run]]
    return at, found


def _old_strings(table: pa.Table) -> pa.Table:
    """To each chunk the strings it sent that an earlier document outside the chunk holds.

    What a chunk has sent to itself goes back as it is.
    """
    if table.column("bucket")[0].as_py() < 0:
        kinds = pa.array(np.full(table.num_rows, OWN, dtype=np.int32))
        return pa.table({"chunk": table.column("chunk"), "kind": kinds, "payload": table.column("payload")})
    records, chunks = exchange.received(table, exchange.FIRST)
    order = np.lexsort((records["doc"], records["h"], records["k"]))
    records, chunks = records[order], chunks[order]
    first = exchange.changes(records["k"], records["h"])
    keep = records["doc"][first][np.cumsum(first) - 1] < records["doc"]
    out = np.empty(int(keep.sum()), dtype=OLD_STRING)
    out["k"], out["h"] = records["k"][keep], records["h"][keep] & np.uint64(0xFFFFFFFF)
    return exchange.answer(out, chunks[keep], STRINGS)


def _send_strings(buckets: int):
    """Strings of halves to take apart; to the chunk itself, under a negative bucket, what is said of its runs."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.send(np.zeros(0, dtype=exchange.FIRST), 0, buckets)
        chunk = exchange.chunk_of(table)
        kinds = told.column("kind").to_numpy()
        shared = told.filter(pa.array(kinds < 0))
        shared = shared.set_column(1, "bucket", pa.array(-1 - shared.column("kind").to_numpy()))
        found = list(_parts(_in_order(table), exchange.short_answers(shared), buckets, False))
        old, said = _judge(told, np.concatenate([r for _, r in found]))
        said = np.split(np.where(old, OLD, said), np.cumsum([len(r) for _, r in found])[:-1])
        every = []
        for (part, _), own in zip(found, said, strict=True):
            of_runs = np.zeros(len(part.runs.key), dtype=np.uint8)
            of_runs[part.shared] = own
            every.append(of_runs)
        strings = [_apart(part, own)[1] for (part, _), own in zip(found, every, strict=True)]
        sent = exchange.send(exchange.combine_firsts(np.concatenate(strings)), chunk, buckets)
        own = {"bucket": [-1 - chunk], "chunk": [chunk], "payload": [np.concatenate(every).tobytes()]}
        return pa.concat_tables([sent, pa.table(own, schema=sent.schema)])

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """All bytes of the UTF-8 characters of which a byte is gone."""
    character = np.cumsum((data & 0xC0) != 0x80)
    return (np.bincount(character, weights=gone) > 0)[character]


def _remove(table: pa.Table, told: pa.Table, characters: bool) -> pa.Table:
    table = _in_order(table) if table.num_rows else table
    n = table.num_rows
    n_bytes, n_removed, n_spans = (np.zeros(n, np.int64) for _ in range(3))
    kept: list[bytes] = []
    said = exchange.answers(told, OWN, np.dtype(np.uint8))
    parts, done = [], 0
    for data, offsets, ids, rows in _slices(table) if n else ():
        runs = _runs(_grams(data, 0), offsets)
        parts.append((Part(data, offsets, ids, rows, runs, runs.at[:0]), said[done : done + len(runs.key)]))
        done += len(runs.key)
    strings = [_apart(part, own) for part, own in parts]
    earlier = exchange.answers(told, STRINGS, OLD_STRING)
    earlier = earlier[np.lexsort((earlier["h"], earlier["k"]))]
    own = [f for _, f in strings]
    firsts = exchange.combine_firsts(np.concatenate([np.zeros(0, dtype=exchange.FIRST), *own]))
    for ((data, offsets, _, (a, b), runs, _), own_said), (at, found) in zip(parts, strings, strict=True):
        gone_runs = own_said == OLD
        first = firsts["doc"][exchange.lookup(firsts, found["k"], found["h"])]
        outside = exchange.lookup(earlier, found["k"], found["h"] & np.uint64(0xFFFFFFFF)) >= 0
        begins = at[outside | (first < found["doc"])]
        depth = np.zeros(len(data) + 1, dtype=np.int32)
        depth[begins] += 1
        depth[begins + MATCH_BYTES] -= 1
        depth[runs.low[gone_runs]] += 1
        np.subtract.at(depth, runs.high[gone_runs] + MATCH_BYTES, 1)
        gone = np.cumsum(depth[:-1]) > 0
        if characters and gone.any():
            gone = _whole_characters(data, gone)
        text = np.repeat(np.arange(b - a), np.diff(offsets))
        opens = gone & exchange.changes(gone, text) if len(data) else gone
        n_bytes[a:b] = np.diff(offsets)
        n_removed[a:b] = np.bincount(text, weights=gone, minlength=b - a)
        n_spans[a:b] = np.bincount(text, weights=opens, minlength=b - a)
        whole = data[~gone].tobytes()
        cuts = np.concatenate([[0], np.cumsum(n_bytes[a:b] - n_removed[a:b])])
        kept.extend(whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))
    columns = {
        "id": table.column("id"),
        "n_bytes": pa.array(n_bytes),
        "n_removed": pa.array(n_removed),
        "n_spans": pa.array(n_spans),
        "kept": pa.array(kept, pa.binary(), mask=table.column("text").is_null().to_numpy()),
        "rest": table.column("rest"),
    }
    return pa.table(columns)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", characters: bool = False
) -> DataFrame:
    """Remove each byte covered by 50 bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes; matches overlap freely, never cross documents and are judged on
    the input. Returns ``id, n_bytes, n_removed, n_spans, kept`` (binary) and ``rest``, the
    struct of all other columns. A cut can fall inside a character; with ``characters`` the
    rest of that character goes too, so that what is kept is text. A null text counts as empty and
    its ``kept`` is null; texts under 50 bytes lose nothing. A null id counts as larger than every
    id. Rows that repeat an id don't remove each other's bytes. Memory is bounded by a
    chunk of 16 MB or the longest text.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        storage.others(docs, id_column, text_column).alias("rest"),
    )
    chunks = storage.chunk_count(rows, "text")
    placed = rows.withColumns({"chunk": storage.spread(chunks), "row": F.monotonically_increasing_id()})
    kept = storage.settle_in_chunks(placed, chunks, "suffixes")
    texts = kept.select("chunk", "row", "id", "text")

    def round_of(told: DataFrame, send) -> DataFrame:
        return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(send, exchange.SENT)

    sent = texts.groupBy("chunk").applyInArrow(_send_suffixes(chunks), exchange.SENT)
    shared = sent.groupBy("bucket").applyInArrow(exchange.shared_short, exchange.SHORT_ANSWER)
    shared = storage.settle(shared, "suffix-buckets")
    sent = round_of(shared, _send_runs(chunks))
    said = sent.groupBy("bucket").applyInArrow(_sort_runs, exchange.ANSWER)
    of_buckets = shared.select("chunk", (-1 - F.col("bucket")).alias("kind"), "payload")
    sent = round_of(said.unionByName(of_buckets), _send_strings(chunks))
    told = sent.groupBy("bucket").applyInArrow(_old_strings, exchange.ANSWER)
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
            T.StructField("kept", T.BinaryType()),
            kept.schema["rest"],
        ]
    )

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        return _remove(table, told, characters)

    return kept.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, schema)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its bytes, those that earlier documents hold, and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )
